"""Operators for training-data pipelines: text, licences, pages, conversations and vectors."""
