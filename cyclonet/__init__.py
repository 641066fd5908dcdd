"""Contact-network and cyclic-panel analysis as Spark jobs."""
