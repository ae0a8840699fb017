"""Corpus operators for preparing training text."""
