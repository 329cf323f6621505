"""Streams of inserts and deletes."""
