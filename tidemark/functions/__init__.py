"""Scalar helpers: checksums, codecs and Bloom filters."""
