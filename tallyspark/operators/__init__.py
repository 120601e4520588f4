"""DataFrame operators grouped by subject."""
