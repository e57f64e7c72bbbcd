"""Code-graph retrieval and analytics as DataFrame pipelines on Spark."""

__version__ = "0.1.0"
