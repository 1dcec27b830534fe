"""Training-data operators for document collections, each a DataFrame-to-DataFrame function.

Nothing else in the library imports this subpackage.
"""
