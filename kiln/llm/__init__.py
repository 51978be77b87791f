"""Operators of a training-data pipeline: tokens, quality, language, secrets, near copies and packing.

Nothing else in the library imports this subpackage.
"""
