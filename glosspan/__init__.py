"""glosspan: span-relational document analytics on Spark DataFrames."""

__all__ = ["__version__"]
__version__ = "0.1.0"
