"""Index building, search and result evaluation over DataFrames."""
