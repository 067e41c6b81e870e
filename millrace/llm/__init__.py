"""Operators for training data: similar vectors, languages, token ids, leaked test texts, personal data."""
