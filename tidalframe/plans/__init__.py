"""Registered queries over the given tables, each with the SQL that gives the same rows where SQL can."""
