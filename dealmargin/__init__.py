"""Contract profit-and-loss analytics over ERP-shaped tables, as Spark DataFrames."""
