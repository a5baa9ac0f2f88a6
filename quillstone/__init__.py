"""Quillstone: document, retrieval and finance analytics as PySpark DataFrame plans."""

__version__ = "0.1.0"
