"""Grids from tables."""
