"""Operators for training-data corpora: near-duplicates, sharding, language models, classifiers, archives, packing."""
