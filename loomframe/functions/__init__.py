"""Formulas, named formulas and units."""
