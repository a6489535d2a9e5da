"""Evidence-linking analytics on PySpark."""
