"""Lexicon costs trained by a conditional random field."""
