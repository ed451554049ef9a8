"""Column expressions: identifiers, geometry, classification and casts."""
