"""Operators for preparing language-model training data.

Ten operators, each in a module of its own; ``queries`` registers one query per
operator.  Nothing outside this package imports it.
"""
