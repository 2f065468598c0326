"""Column functions: text, time and rules."""
