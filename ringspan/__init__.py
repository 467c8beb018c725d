"""ringspan: Spark-native analytics over libraries of annotated circular sequences."""

__version__ = "0.1.0"
