"""Spark jobs that build, search, audit and maintain a versioned documentation knowledge base."""
