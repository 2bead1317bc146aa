"""Operators of a training-data pipeline: filters, duplicates, decontamination, mixing.

Nothing outside this folder imports it.
"""
