"""Readers and writers of tracking tables."""
