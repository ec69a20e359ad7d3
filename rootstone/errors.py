"""What can go wrong. Integrity failures are errors, never data."""


class LedgerError(Exception):
    """Any failure of the library."""


class BackendError(LedgerError):
    """Storage could not be read or written."""


class CorruptedError(LedgerError):
    """Stored data does not match its commitment."""


class MissingError(LedgerError):
    """What is asked for was pruned or never stored."""


class InvalidError(LedgerError):
    """The call itself is wrong."""


class ConflictError(LedgerError):
    """Another transaction committed first."""


class DuplicateKeyError(LedgerError):
    """A primary or unique key is taken."""
