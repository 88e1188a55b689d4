"""Readers for corpora, word lists, dictionaries and annotation tables."""
