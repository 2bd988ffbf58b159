"""Multi-step flows: preparation, catalog, registry, training, scoring."""
