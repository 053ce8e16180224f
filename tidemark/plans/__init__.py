"""Declared column plans: running them and reading their logs."""
