"""Planning: shared storage, skew handling, execution modes."""
