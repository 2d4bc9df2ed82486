"""dialoglens: conversation analytics on Spark DataFrames and Structured Streaming."""

from dialoglens.tables import Tables

__all__ = ["Tables"]
