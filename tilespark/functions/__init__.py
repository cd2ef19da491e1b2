"""Codecs and numeric filters as pure functions and as vectorised columns."""
