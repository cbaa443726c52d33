"""Text features and the two random forests, on Spark ML."""
