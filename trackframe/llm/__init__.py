"""Operators for preparing training text: scoring, filtering, matching and packing of documents."""
