"""Order analytics on Spark DataFrames: cleaning, star schema, reports, tests, delivery risk."""
