"""Training-sample pipelines as lazily evaluated Spark plans."""
