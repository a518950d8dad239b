"""Operators that prepare training text: filters, near duplicates, mixing, scoring.

Nothing outside this folder imports it, so it can be removed as a whole.
"""
