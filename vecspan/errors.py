"""What can go wrong, by kind."""

from __future__ import annotations


class VecspanError(Exception):
    """Any error of the engine."""


class DimensionMismatch(VecspanError, ValueError):
    def __init__(self, expected: int, actual: int):
        super().__init__(f"the collection holds vectors of {expected} numbers, this one has {actual}")
        self.expected, self.actual = expected, actual


class CollectionExists(VecspanError, ValueError):
    def __init__(self, name: str):
        super().__init__(f"there is a collection named {name!r} already")


class CollectionNotFound(VecspanError, KeyError):
    def __init__(self, name: str):
        super().__init__(f"no collection is named {name!r}")

    def __str__(self) -> str:
        return str(self.args[0])


class InvalidConfig(VecspanError, ValueError):
    """An option or argument that makes no sense."""


class InvalidVector(VecspanError, ValueError):
    """Not finite, or without a direction where one is needed."""


class Corrupted(VecspanError, ValueError):
    """Files that don't hold what they should."""


class Locked(VecspanError, RuntimeError):
    """Another process has the database open for writing."""


class ReadOnlyReplica(VecspanError, RuntimeError):
    def __init__(self):
        super().__init__("a follower takes no writes; send them to the primary")


class StorageError(VecspanError, OSError):
    """The file system refused something."""


class Unreachable(VecspanError, OSError):
    """A primary that doesn't answer, or answers with an error."""
