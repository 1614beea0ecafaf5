"""tessera: DataFrame-in / DataFrame-out analytics over dialogue, panel and document data on Spark."""
