"""Operators of a training-data pipeline over captured pages and texts.

Nothing outside this package imports it.
"""
