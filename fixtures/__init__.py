"""A synthetic ledger made from the driver's tables, encoded to real record bytes."""
