"""Operators for large-scale training-data pipelines.

Operators over documents, pages and conversations, one module each; ``queries.py``
holds the registered ``opN_<name>`` queries.  Nothing outside this package
imports it.
"""
