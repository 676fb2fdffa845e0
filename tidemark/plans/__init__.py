"""Registered queries: what each operator computes over the driver's tables."""
