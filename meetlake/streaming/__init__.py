"""Streaming of the meeting analytics engine."""
