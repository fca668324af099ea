"""Readers and writers of other formats."""
