"""rowsmith: synthetic relational tables, constraint repair, quality metrics,
masking, a bronze/silver/gold flow and JSON event streams, all as Spark
DataFrame operators."""

__version__ = "0.1.0"
