"""Query catalogue (one callable per operator) and the benchmark workflow."""
