"""Where results are published."""
