"""Point-in-time panel analytics and corpus preparation on Spark DataFrames."""
