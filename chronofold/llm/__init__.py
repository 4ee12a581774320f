"""Operators for large-scale training-data pipelines.

Nothing else in the library imports this subpackage.  ``registry.queries()``
holds one thin ``opN_<name>`` query per operator.
"""
