"""Repository, corpus and event-stream analytics as Spark DataFrame operators."""
