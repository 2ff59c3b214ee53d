"""Survey and discrete-choice analytics expressed as Spark DataFrame jobs."""
