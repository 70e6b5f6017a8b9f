"""Exports of a run, and the ledger of runs."""
