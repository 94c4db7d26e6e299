"""Training-data operators: one module each, all taking and returning DataFrames."""
