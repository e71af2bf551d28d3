"""Bundled grammars, one text file per language."""
