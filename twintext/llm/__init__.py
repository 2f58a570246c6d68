"""Training-data operators: deduplication, filtering, classification and mixing.

Nothing else in ``twintext`` imports this subpackage.
"""
