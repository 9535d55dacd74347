"""Readers for trips and zones."""
