"""docloom: collections of documents to Markdown, as Spark DataFrames."""
