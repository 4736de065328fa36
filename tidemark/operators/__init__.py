"""Reusable DataFrame operators: quality split, global rank, score curve, upsert, profile, measures."""
