"""framewright: Spark-native analytics over object-detection datasets and training corpora."""

__version__ = "0.1.0"
