"""Graph analytics over changing graphs, as Spark DataFrame jobs."""
