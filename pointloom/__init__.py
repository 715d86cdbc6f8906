"""pointloom: spatial point-cloud analytics expressed as PySpark DataFrame plans."""
