"""Operators of a training-data pipeline over the ``documents``, ``labels`` and ``embeddings`` tables."""
