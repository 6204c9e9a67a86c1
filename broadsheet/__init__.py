"""broadsheet: a Spark-native engine that turns tables of web pages into article metadata."""

__version__ = "0.1.0"
