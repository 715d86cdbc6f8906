"""Plan helpers shared by the operators: lineage cuts and skew-safe joins."""
