"""Part of the ledgerline engine."""
