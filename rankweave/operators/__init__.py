"""Relational building blocks: aggregates, encoding, numbering, filters, splits."""
