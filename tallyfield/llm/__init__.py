"""Operators for training-data pipelines: ten methods, each over whole tables.

Nothing outside this package imports it; ``queries.py`` lists the registered queries.
"""
