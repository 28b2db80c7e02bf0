"""DataFrame -> DataFrame operators of the document store."""
