"""Column expressions: grades, identifiers, notes and text."""
