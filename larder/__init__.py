"""larder: package-landscape analytics expressed as Spark DataFrame jobs."""
