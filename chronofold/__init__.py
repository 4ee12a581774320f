"""chronofold: Spark-first queries over ordered change logs and replicated logs."""

__version__ = "0.1.0"
