"""Readers and writers of readings, predictions, registry and audit tables."""
