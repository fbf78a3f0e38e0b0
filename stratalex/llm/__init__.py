"""Operators for preparing large text corpora for model training.

Nothing outside this subpackage imports it; ``__spark_entry__`` adds its
queries only where it is present.
"""
