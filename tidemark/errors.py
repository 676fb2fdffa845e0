"""Errors of the store."""


class StoreError(Exception):
    """Base of the store's errors."""


class NotFound(StoreError, KeyError):
    """The key has no live value."""


class Closed(StoreError):
    """The store was closed."""


class EmptyKey(StoreError, ValueError):
    """A key of no bytes."""


class CorruptLog(StoreError):
    """A log frame fails its checksum although valid frames follow it."""


class Conflict(StoreError):
    """Another writer has published a snapshot since this one was read."""
