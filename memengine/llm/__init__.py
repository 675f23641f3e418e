"""Operations of a training-data pipeline: deduplication, packing, tokenizing, sharding, scoring, filtering.

Nothing else in the library imports this subpackage.
"""
