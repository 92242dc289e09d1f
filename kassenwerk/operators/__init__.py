"""Relational building blocks: filters, per-transaction sides, time lookups, upserts."""
