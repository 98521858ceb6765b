"""brightloom: data-processing operators declared on Spark's DataFrame and SQL API."""
