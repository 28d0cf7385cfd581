"""Operators for preparing language-model training data at scale.

Nothing outside this folder imports it.  Each module holds one operator with a
general interface; ``queries`` holds the thin contract queries built on them.
"""
