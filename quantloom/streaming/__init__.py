"""The engine is batch: late and revised data are handled by ``available_at`` and first-filed
rules. Operators that are row-wise or mergeable aggregates (visibility filters, implied
positions, order costs) accept streaming DataFrames as they are; ``tests/test_book.py`` runs
one that way."""
