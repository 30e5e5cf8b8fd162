"""Operators on free text and entity data for training-data pipelines."""
