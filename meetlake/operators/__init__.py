"""Operators of the meeting analytics engine."""
