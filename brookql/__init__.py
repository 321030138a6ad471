"""brookql: a streaming-SQL analytics engine that compiles to Spark plans."""
