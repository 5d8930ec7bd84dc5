"""Readers of corpora and term lists, and writers of what the operators make."""
