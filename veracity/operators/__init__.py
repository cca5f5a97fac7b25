"""Operators: row checks, key checks, mapping and premium rating."""
