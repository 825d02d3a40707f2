"""River-habitat analytics expressed as Spark DataFrame jobs."""
