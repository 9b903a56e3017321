"""Grids, maps, runs and reductions."""
