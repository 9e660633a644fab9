"""dealerlens: sales-desk customer analytics as Spark DataFrame and
Structured Streaming operators."""

__version__ = "0.1.0"
