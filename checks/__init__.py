"""Queries over the test tables, each beside the SQL that gives the same result."""
