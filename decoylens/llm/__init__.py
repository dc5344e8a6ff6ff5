"""Training-data operators: each one a Spark job over a corpus table. Nothing outside imports this package."""
