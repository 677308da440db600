"""Market-bid analytics as Spark DataFrame plans."""
