"""Keeping merged tables up to date from a folder of fragments."""
