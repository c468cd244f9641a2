"""Transcript and text-corpus analytics on Spark."""
