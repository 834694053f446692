"""Network inference and data-preparation operators on PySpark DataFrames."""

__version__ = "0.1.0"
