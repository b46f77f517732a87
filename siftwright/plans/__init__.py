"""Dimension tables and composite pipelines."""
