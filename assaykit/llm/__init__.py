"""Operators of a training-data pipeline over the tables of documents, pages, labels and benchmark items.

Nothing outside this package imports it. Every operator takes a DataFrame and names of columns, keeps whole
texts, and returns a DataFrame.
"""
