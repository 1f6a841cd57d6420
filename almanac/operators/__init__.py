"""DataFrame operators: each takes DataFrames/column names and returns a DataFrame or Column."""
