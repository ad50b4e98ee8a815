"""Operators that prepare document text for language-model corpora.

Nothing outside this package imports it; ``queries`` lists what it offers.
"""
