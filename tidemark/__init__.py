"""tidemark: price-index analytics and corpus preparation as Spark DataFrame programs."""
