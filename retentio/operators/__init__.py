"""Analytical operators (pure DataFrame -> DataFrame functions)."""
