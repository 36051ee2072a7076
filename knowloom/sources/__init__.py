"""Readers and stores: documents, change events, snapshots, vectors, ledger, sessions."""
