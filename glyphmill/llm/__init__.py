"""Operators of a training-data pipeline: scans, classifiers, deduplication, packing.

Nothing outside this subpackage imports it.
"""
