"""Whole plans: from files to documents with chapters, images and metadata."""
