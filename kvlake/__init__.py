"""A versioned, ordered key-value store as Spark queries over a log of mutations."""
