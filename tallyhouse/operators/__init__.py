"""Operators: normalising, identity, metrics, attribution and rules."""
