"""Registered queries: each reads the given tables and calls the operators; most carry a SQL twin."""
