"""Annotation, counting, extraction, ranking and evaluation as DataFrame operators."""
