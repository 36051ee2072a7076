"""Operators on text for training data: splitting, name variants, token ids, mixing, wrong encodings."""
