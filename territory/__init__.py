"""Field-sales analytics and ingestion on Spark DataFrames."""
