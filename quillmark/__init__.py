"""quillmark: content and citation analytics on Spark DataFrames."""
