"""Column-level building blocks: fixed values, scalar helpers, measures, features."""
