"""DataFrame operators: cleaning, merging, charts, validation, catalog."""
