"""Query bindings on the shared test tables, with their SQL oracles."""
