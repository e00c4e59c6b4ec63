"""Readers and writers for the file shapes the jobs exchange."""
