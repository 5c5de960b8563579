"""Readers, idempotent writers, and the adapter from the benchmark tables to a journal."""
