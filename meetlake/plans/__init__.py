"""Plans of the meeting analytics engine."""
