"""Training-data operators: text and conversation tables in, DataFrames out."""
