"""Operators of a training-data pipeline: scoring, filtering, deduplication, decontamination and mixing."""
