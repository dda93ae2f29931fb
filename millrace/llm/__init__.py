"""Operators for preparing training text: dedup, filtering, scoring, tokenising and packing."""
