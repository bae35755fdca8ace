"""Readers of pages, documents, reviews, stage files and service responses."""
