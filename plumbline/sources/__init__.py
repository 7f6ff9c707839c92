"""Landed payloads as relations, and the files that are written back."""
