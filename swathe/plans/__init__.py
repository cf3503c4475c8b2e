"""Plan building blocks: cutting lineage, skew-safe joins, connected components."""
