"""tapelake: recorded agent sessions and evaluation runs as Spark tables."""
