"""tidelog: analytics over append-only, per-entity event logs on Spark."""
