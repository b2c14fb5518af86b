"""tidemark: profiling, metadata packs, retrieval, SQL policy and guarded previews on PySpark DataFrames."""
