"""Operators for training-data pipelines: decontamination, scoring, de-duplication, packing and more."""
