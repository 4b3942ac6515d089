"""Composite plans: fixture views, the training-set flow, the query catalog."""
