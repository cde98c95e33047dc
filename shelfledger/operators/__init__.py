"""Domain operators.  Each one takes DataFrames and returns a DataFrame."""
