"""Queries built from the operators, and the SQL that they are held against."""
