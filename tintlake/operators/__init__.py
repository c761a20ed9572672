"""Jobs over whole tables; every function maps DataFrames to DataFrames."""
