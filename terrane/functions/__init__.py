"""Column functions and numeric kernels."""
