"""Operators on delimited text: scans, folds, segments and the record index."""
