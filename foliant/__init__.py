"""Document analytics on Spark: documents of many formats become queryable tables."""
