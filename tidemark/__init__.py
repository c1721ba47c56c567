"""Threshold scoring of card transactions on tables and streams."""
