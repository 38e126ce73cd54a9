"""Training-data operators over tables of documents.

Nothing outside this subpackage imports it.
"""
