"""Operators of a training-data pipeline: cleaning, near copies, sharding, formatting, tokens, packing."""
