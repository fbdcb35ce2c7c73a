"""Expressions over array columns."""
