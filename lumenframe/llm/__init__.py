"""Operators for training-data pipelines. Nothing else in the library imports this package.

Operators keep the columns of their input unless they say otherwise. Names
that start with an underscore are theirs while they work.
"""
