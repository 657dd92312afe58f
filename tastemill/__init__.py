"""Rating, catalog and recommendation analytics expressed as Spark DataFrame operators."""
