"""Operators for large training corpora; the rest of the library never imports this."""
