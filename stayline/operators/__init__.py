"""Relational operators over the business tables."""
