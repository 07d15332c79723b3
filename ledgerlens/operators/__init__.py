"""Relational operators of the ledger library (joins, roll-ups, windows,
correlation, forecasting, training and scoring)."""
