"""marlstone: document retrieval, question context and training-data preparation as PySpark DataFrames."""

__version__ = "0.1.0"
