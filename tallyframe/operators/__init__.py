"""Relational operators over the event ledger, its relationships and its entities."""
