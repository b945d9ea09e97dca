"""Relational operators: exact and near duplicates, components, clustering, snapshot merges."""
