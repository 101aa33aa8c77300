"""Operators for training-data pipelines. Nothing else in weirflow imports this subpackage."""
