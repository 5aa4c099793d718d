"""Query plans: the registered queries (one per operator) and their SQL oracles."""
