"""Relational operators over tables of lines, blocks, intervals and issues."""
