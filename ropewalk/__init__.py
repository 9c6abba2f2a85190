"""Analytics over linked structures (lists, forests, graphs) kept as Spark tables."""
