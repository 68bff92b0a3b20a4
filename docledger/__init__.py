"""docledger: financial-document analytics on Spark."""
