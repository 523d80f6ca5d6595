"""Operators over intervals, scores and labels, as DataFrame expressions."""
