"""Training-data operators (documents in, documents or per-document facts out).

Nothing else in the package imports this subpackage.
"""
