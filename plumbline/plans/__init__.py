"""Whole queries built from the functions and operators."""
