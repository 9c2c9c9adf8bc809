"""Physical helpers shared by the operators: shared-folder tables and skew-proof joins."""
