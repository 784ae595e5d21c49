"""textpair: building and judging text-to-query datasets with Spark DataFrames."""

from textpair.session import configure, get_session

__all__ = ["configure", "get_session"]
