"""foliomill: document-layout analytics as PySpark DataFrame programs."""
