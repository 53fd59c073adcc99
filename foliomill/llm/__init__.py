"""Operators of a training-data pipeline; nothing else in foliomill imports this package."""
