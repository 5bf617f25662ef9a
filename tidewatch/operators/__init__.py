"""Relational operators on DataFrames; key columns are arguments, all lazy."""
