"""Operators for training-data pipelines: scoring, deduplication, decontamination, mixing, sharding and token counts.

One module an operator, each with a general interface; ``queries`` holds the registered queries and ``oracles`` their SQL twins.
"""
