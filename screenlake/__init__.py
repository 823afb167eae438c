"""Access-trace screening and evidence analytics as Spark jobs."""
