from ledgerlake.sources.snapshot import LedgerAccounts, LedgerArchives, LedgerSnapshot, register

__all__ = ["LedgerAccounts", "LedgerArchives", "LedgerSnapshot", "register"]
