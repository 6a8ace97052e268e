"""Column functions: text repair, normalisation, geometry, ordering keys."""
