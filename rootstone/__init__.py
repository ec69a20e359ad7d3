"""rootstone: authenticated, versioned tables on PySpark."""

__version__ = "0.1.0"
