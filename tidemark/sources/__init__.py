"""Readers and writers: binary logs and tables, manifests, and the store."""
