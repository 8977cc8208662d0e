"""Profiles of columns, model inference, merging, validation and generation."""
