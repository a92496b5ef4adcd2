"""DataFrame operators of the ranking engine."""
