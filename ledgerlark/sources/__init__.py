"""Ledgers made from tables."""
