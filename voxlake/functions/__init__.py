"""Helpers shared by the operators."""
