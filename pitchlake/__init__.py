"""Sports-performance analytics as plain PySpark DataFrame functions."""
