"""Training-data operators: near-duplicates, extraction, scoring, sharding and the like.

Nothing else in the library imports this subpackage.
"""
