"""loomgraph: code-repository analytics expressed as Spark DataFrame plans."""
