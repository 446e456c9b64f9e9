"""Readers and writers of annotations and results."""
