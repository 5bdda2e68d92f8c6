"""Document-record analytics on Spark: layout JSON in, reviewed records out."""

__version__ = "0.1.0"
