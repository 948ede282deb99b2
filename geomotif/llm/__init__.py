"""Training-data operators: mixing, extraction, sharding, joins, packing and the rest.

Nothing outside this package imports it.
"""
