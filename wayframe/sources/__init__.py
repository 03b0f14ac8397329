"""Readers and writers of driving-log data."""
