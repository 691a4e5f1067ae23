"""Subpackage of the corpus-mining engine."""
