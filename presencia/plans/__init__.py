"""Whole programs made of operators."""
