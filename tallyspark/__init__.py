"""Ledger and document analytics on Spark."""
