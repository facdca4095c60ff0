"""Operators for text and page corpora: encoding, deduplication, filtering, archives and scoring."""
