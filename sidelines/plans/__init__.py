"""Adapter tables, registered queries and SQL that gives the same rows."""
