"""Column expressions: odds, stakes, grades, rates, parsing."""
