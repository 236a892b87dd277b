"""ledgerlark: ledger analytics over Spark DataFrames."""
