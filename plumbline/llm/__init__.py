"""Operators that prepare text corpora for training language models.

Nothing outside this package imports it.  Each module holds one operator with
its own general interface; ``queries`` holds the thin queries over the tables.
"""
