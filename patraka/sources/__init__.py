"""Readers and writers of transcript data."""
