"""Document-structure analytics on Spark: positioned text lines in, logical structure out."""
