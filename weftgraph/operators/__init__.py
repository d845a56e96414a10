"""Operators on edges, on vertices dealt out to parts, on labels, and on contractions."""
