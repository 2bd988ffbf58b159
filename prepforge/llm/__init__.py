"""Operators for preparing training text at scale: filters, deduplication, scoring, mixing, packing."""
