"""Operators for large text corpora: scanning, formatting, archives, packing, joins, classifiers and search."""
