"""Live forms of the rules."""
