"""The query catalogue: each module pairs Spark queries with their SQL twins."""
