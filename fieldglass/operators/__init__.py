"""Relational building blocks: predicates, views, joins, rankings and aggregates."""
