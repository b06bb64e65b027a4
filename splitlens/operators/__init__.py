"""Relational operators of the experiment analysis, each ``DataFrame -> DataFrame``."""
