"""Plans: operators put together, and the registered queries."""
