"""Readers, cleaners, stores and registries."""
