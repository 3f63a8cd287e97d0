"""Operators on texts: encoding, packing, sentence units. Nothing else in the library imports this package."""
