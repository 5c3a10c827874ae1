"""Operators on DataFrames of lines, blocks, index entries, chunks and search records."""
