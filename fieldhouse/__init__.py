"""Sports analytics on Spark: catalogs, point-in-time features, odds, evaluation, quality and live snapshots."""
