"""Evidence analytics on Spark: DataFrame operators over pages, facts, reviews and line-ups."""
