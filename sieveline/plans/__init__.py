"""Queries over the fixture tables and SQL that gives the same rows."""
