"""Registry, workflow graphs, and the queries that are registered for checks."""
