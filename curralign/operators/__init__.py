"""Relational, graph and vector operators."""
