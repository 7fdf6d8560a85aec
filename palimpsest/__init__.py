"""Transcript reconciliation and run/account ledger analytics as Spark jobs."""
