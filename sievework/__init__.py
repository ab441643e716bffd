"""Evidence analytics on Spark: DataFrame operators over text collections and search payloads."""
