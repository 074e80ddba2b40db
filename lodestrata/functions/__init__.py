"""Column-level functions: value policy, formula compiler, distributions."""
