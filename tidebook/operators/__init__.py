"""Operators of the ledger and of its measurements."""
