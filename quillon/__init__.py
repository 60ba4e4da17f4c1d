"""A Spark engine for document processing and ledger reconciliation."""
