"""Whole reports, and the register of queries over the sample tables."""
