"""kvasir: document-store analytics on Spark DataFrames."""
