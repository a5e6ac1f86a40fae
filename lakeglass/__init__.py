"""Business analytics and text-corpus operators for Spark DataFrames."""
