"""Numeric kernels in NumPy and scalar helpers; none of them needs a Spark session."""
