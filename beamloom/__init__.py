"""Plan-versus-delivery spot analytics on Spark DataFrames."""
