"""Sources of the meeting analytics engine."""
