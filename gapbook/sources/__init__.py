"""Readers, cleaners and writers of bars and reference tables."""
