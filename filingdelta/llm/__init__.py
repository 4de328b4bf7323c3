"""Operators for training data: token output, filters, deduplication, decontamination, personal data, tokenizing."""
