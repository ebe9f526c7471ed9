"""Registered queries: each pairs a DataFrame program with the SQL that must give the same rows."""
