"""Operators for preparing large text corpora: deduplication, scoring, pseudonyms, packing and vector search."""
