"""Training-data operators: ten corpus operators and the queries that apply them.

Nothing else in the library imports this subpackage.
"""
