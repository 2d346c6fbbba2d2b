"""Composite plans: serving tools, maintenance and audits."""
