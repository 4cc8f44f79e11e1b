"""Operators of a training-data pipeline: chat formatting, fingerprints, joins, language model, filters, tokens, mixing."""
