"""weft: evidence-graph and corpus analytics written as Spark DataFrame jobs."""
