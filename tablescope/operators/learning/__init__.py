"""Statistical learning operators on Spark ML."""
