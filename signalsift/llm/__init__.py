"""Operators of a training-data pipeline: extraction, formatting, packing,
filters, near duplicates, decontamination and sharding of text corpora."""
