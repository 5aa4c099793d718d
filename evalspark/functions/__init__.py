"""Column-expression helpers (pure Catalyst expressions, no Python UDFs)."""
