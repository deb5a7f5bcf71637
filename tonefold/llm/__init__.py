"""Operators for building training corpora: counting, filtering, matching and packing documents."""
