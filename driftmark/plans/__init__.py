"""Composite plans (assigner -> windows -> analysis), the sweep, and the
registered query catalog with its SQL oracles."""
