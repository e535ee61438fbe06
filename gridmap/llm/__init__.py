"""Operators of a large-scale training-data pipeline (documents, pages, benchmark, labels).

Nothing else in the package imports this subpackage; ``queries`` holds the registered queries.
"""
