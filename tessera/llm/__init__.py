"""Operators for large training-data pipelines: scanning, de-duplication, tokenising, mixing and scoring text."""
