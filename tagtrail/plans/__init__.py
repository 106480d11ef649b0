"""Registered queries with their SQL, and tables written between stages."""
