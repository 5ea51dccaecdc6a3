"""Operators for large-scale training-data preparation.

Nothing else in the library imports this subpackage. Every operator takes a
DataFrame plus the names of its key and text columns and returns a DataFrame;
``queries`` holds the thin ``opN_*`` queries derived from them.
"""
