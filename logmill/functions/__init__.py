"""Column expressions: tokenisers, template rewriting, regex alignment, distances."""
