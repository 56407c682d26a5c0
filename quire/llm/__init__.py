"""Operators for training text: pairs, sentences, pieces, scans, truncation, tokens, mixtures, personal data."""
