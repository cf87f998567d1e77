"""Column expressions and small Arrow-batch kernels."""
