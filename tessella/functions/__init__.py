"""Scalar functions with the semantics of the dialect where Spark's own differ. Each takes and gives Columns."""
