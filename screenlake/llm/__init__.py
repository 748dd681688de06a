"""Operators for building language-model training data, one module each.

Nothing outside this subpackage imports it.
"""
