"""Readers and writers of array containers as Spark data sources."""
