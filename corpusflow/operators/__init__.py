"""DataFrame operators keyed by an explicit order, so layout never changes a result."""
