"""docmill: a document-library engine expressed as Spark DataFrame plans."""
