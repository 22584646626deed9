"""Relational operators over the registers."""
