"""Operators for training texts and deduplication; nothing else in the library imports this subpackage."""
