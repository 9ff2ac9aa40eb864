"""Readers and writers for delimited tables, lines, matrices and token files."""
