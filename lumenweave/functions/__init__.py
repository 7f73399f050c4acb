"""Scalar functions that keep the meaning of the checks they serve, as Columns where Spark can express them."""
