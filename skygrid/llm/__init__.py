"""Operators for preparing language-model training corpora at cluster scale.

Nothing outside this subpackage imports it; the registry in ``queries.py``
lists its queries for the driver's entry module.
"""
