"""Readers and writers of fragments, indexes, manifests and source trees."""
