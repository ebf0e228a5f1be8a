"""Readers, writers and assembly of datasets."""
