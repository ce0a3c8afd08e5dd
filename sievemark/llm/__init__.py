"""Operators that prepare text for training corpora.

Self-contained: nothing outside this subpackage imports it, and it may be
deleted without effect on the rest of the library.
"""
