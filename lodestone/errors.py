"""What an engine call can fail with."""


class LodestoneError(Exception):
    """Base of all errors of the engine."""


class NoData(LodestoneError):
    """The item or key isn't there."""


class InvalidArguments(LodestoneError):
    """An option, an input or a name isn't acceptable."""


class AssertionFailure(LodestoneError):
    """Stored data contradicts itself."""


class SystemFailure(LodestoneError):
    """A file or table can't be read or written."""


class NotSupported(LodestoneError, NotImplementedError):
    """The engine has no such operation."""
