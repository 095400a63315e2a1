"""Multi-operator plans: calendar periods, period comparison, snapshots and
the registry of named queries with their DuckDB oracle SQL."""
