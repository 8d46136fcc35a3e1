"""Readers and writers of the catalog's file formats."""
