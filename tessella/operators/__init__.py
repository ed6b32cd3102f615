"""Relational, statistical and vector operators."""
