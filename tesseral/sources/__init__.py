"""Scripts, generated instances and result files."""
