"""Operators for preparing large text corpora.

Nothing else in the library imports this package: removing the folder
removes the operators, their queries and nothing more.
"""
