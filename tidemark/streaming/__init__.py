"""The same column steps and screening on a streaming DataFrame."""
