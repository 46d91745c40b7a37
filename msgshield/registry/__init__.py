"""Registered queries: every operator on the given tables, and the SQL that checks it."""
