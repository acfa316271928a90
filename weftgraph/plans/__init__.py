"""Plan-level helpers: cutting lineage and driving loops."""
