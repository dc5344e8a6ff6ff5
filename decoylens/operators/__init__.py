"""Relational, statistical and learning operators over DataFrames."""
