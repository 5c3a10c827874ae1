"""Registered queries of the engine's operators and the SQL that they are held against."""
