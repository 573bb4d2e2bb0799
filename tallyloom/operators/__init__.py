"""Queries as pure functions of tables and parameters."""
