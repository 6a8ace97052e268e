"""Cross-stage reconciliation and corpus preparation on Spark DataFrames."""
