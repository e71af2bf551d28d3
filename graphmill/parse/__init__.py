"""Symbol parsers of the core: one row per class or function of a file."""
