"""Functions of the meeting analytics engine."""
