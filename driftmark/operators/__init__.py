"""Operators: watermark assigners, lateness, windows, drift detection."""
