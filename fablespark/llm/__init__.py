"""Operators for preparing large text corpora for model training.

Self-contained: nothing else in the library imports this subpackage.
"""
