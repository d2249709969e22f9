"""Relational operators for retrieval, verification, metrics and statistics."""
