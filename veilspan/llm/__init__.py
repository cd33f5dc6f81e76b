"""Operators on training data: text forms, duplicates, samples, mixtures, packing, masking."""
