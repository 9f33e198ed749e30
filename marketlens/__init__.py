"""marketlens: market-data analytics and training-data operators on Spark."""
