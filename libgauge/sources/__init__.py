"""Readers, writers and the seams to the outside."""
