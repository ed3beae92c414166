"""barloom: market time-series analytics expressed as Spark DataFrame plans."""
