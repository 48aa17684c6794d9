"""Grid-aligned bar analytics expressed as Spark DataFrame plans."""
