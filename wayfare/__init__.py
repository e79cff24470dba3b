"""wayfare: travel-document analytics on PySpark."""
