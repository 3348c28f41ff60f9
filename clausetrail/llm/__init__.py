"""Operators for preparing training text: mixing, token files, filters, search and near copies."""
