"""A Spark-first columnar analytics engine: data-frame operators as lazy Spark plans."""
