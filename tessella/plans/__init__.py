"""Expressions, tracing and the choice of strategy."""
