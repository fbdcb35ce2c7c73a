"""Plans: features, and the registered queries."""
