"""Operators for training-data pipelines: joins on n-grams, scoring, cleaning and mixing of texts."""
