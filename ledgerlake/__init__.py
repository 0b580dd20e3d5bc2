"""Ledger-snapshot analytics on Spark.

Snapshot archives are read as a Spark data source, their binary account
records become rows, and three tables come out: ``accounts``, ``mints`` and
``token_accounts``.
"""
