"""Operators for building and cleaning large training corpora.

Nothing outside this subpackage imports it. Each module holds one operator;
``queries`` registers the thin ``opN_<name>`` queries and their SQL.
"""
