"""Relational, selection, statistics and graph operators on DataFrames."""
