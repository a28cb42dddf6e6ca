"""Reusable plan shapes: ranking, exact quantiles, skew handling, lineage."""
