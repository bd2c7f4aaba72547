"""Index, search, fusion, chunking, evaluation and answer operators over DataFrames."""
