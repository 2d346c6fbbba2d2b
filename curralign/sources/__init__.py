"""Readers of tables and of hierarchical, page and JSON inputs."""
