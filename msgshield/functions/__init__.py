"""Column expressions: no shuffles here."""
