"""Chunked arrays, dataset configurations and image sections as tables, and back."""
