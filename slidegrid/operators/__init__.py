"""Operators over patch, pixel, region and result tables."""
