"""assayer: a Spark-first analytics engine for curating media and document collections."""
