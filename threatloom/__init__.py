"""Web-threat, data-leak and training-data analytics as PySpark DataFrame jobs."""
