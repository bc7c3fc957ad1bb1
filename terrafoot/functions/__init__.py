"""Column expressions: tiles, projections, geometry, attributes."""
