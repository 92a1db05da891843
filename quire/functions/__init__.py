"""Column -> Column functions built from native Catalyst expressions."""
