"""Predictions for recordings as they arrive."""
