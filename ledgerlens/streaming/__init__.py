"""Structured Streaming form of ledger ingestion (uploads landing in a folder)."""
