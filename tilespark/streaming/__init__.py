"""Incremental forms of the folds."""
