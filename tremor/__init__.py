"""Change-impact analytics over call graphs, as Spark DataFrame computations."""
