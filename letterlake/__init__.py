"""Mail-archive analytics and corpus preparation on Spark DataFrames."""
