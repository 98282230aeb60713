"""Scalar and array functions: Columns where Spark has them, NumPy kernels where it has not."""
