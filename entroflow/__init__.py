"""Time-series information analytics expressed as Spark DataFrame plans."""
