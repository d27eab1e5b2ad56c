"""Operators for building training data: filters, packing, language ID, fingerprints, joins, mixing, search, scoring."""
