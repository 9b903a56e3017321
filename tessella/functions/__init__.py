"""Functions for kernels."""
