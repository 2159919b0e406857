"""Topic-flow analytics over source-code corpora, as Spark DataFrame jobs."""
