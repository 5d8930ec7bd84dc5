"""Counts over streams of documents."""
