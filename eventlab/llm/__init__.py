"""Operators for preparing training data at corpus scale.

Nothing outside this package imports it.  ``queries`` registers one query for
each operator; each operator also has a general interface of its own.
"""
