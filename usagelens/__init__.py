"""Usage analytics on Spark: who owns what, who uses it, and for how long."""

__version__ = "0.1.0"
