"""Operators for training data: language, duplicates, personal data, licences, search, tokens and packing."""
