"""Operators for preparing language-model training data, as Spark jobs.

Nothing else in the library imports this subpackage. Each module holds one operator; `queries` registers
them over the test tables.
"""
