"""Compositions of operators into the tables a season needs."""
