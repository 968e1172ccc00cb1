"""Plans: the persisted-relation catalog and the registry of named queries."""
