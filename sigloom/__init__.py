"""sigloom: a Spark-native engine for cataloguing, analysing and quality-controlling signal segments."""

__version__ = "0.1.0"
