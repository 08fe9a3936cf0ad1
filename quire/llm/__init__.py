"""Operators for training-data pipelines: ten independent operators and their queries."""
