"""Readers and writers of frames, tables, images and sessions."""
