"""Detection and redaction of personal data in text columns, built on Spark DataFrames."""
