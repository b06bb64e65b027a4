"""Composite plans: the lazy DAGs that chain sources and operators per query."""
