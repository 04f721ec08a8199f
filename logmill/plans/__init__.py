"""Compositions of operators: fixtures, scoring, relabelling, parsing."""
