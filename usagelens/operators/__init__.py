"""The analyses. Each function takes DataFrames and returns a DataFrame."""
