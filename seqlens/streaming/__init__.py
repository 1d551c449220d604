"""Continuous upkeep of the evidence ledger."""
