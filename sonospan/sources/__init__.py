"""Readers and writers of annotation and audio formats."""
