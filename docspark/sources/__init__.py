"""Folders of documents, stored collections and models."""
