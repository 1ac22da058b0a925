"""Rules as functions from DataFrames to DataFrames."""
