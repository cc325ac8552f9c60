"""Sources and stored state."""
