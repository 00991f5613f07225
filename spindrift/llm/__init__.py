"""Operations of a training-data pipeline: deduplication, packing, tokenising, filtering, sharding and classification.

Nothing else in the library imports this subpackage.
"""
