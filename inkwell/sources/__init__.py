"""Readers, writers and the lists that decide what is still to be fetched."""
