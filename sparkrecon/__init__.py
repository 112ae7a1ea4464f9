"""Document-text extraction and ledger reconciliation as Spark DataFrame plans."""
