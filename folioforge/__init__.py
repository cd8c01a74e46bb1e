"""folioforge: document structuring and corpus operators as Spark DataFrame plans."""
