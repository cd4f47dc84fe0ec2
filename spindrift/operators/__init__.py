"""Operators over tables of many series; a series is keyed by `entity` and ordered by (t, pos)."""
