"""DataFrame operators of the contract engine."""
