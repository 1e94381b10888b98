"""Streaming notes.

The data model has no time axis, so there are no stateful stream operators.
Row-local operators (channel filters, saturation, inversion, scaling with a
given maximum, punctum boxes) take and return plain DataFrames and also run on
a ``readStream`` frame unchanged.
"""
