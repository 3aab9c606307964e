"""Queries over the project's tables, each with the SQL that defines its result."""
