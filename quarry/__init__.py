"""quarry: ranked full-text retrieval and text-corpus processing on PySpark DataFrames."""

from quarry.operators.index import Index, build_index, load_index
from quarry.operators.search import search, search_batch

__all__ = ["Index", "build_index", "load_index", "search", "search_batch"]
