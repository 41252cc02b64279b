"""Errors of reading and filtering genotype sources."""

from __future__ import annotations

import re


class SourceResolutionError(Exception):
    """A path can't be used as a genotype source."""


class MissingCompanionFileError(SourceResolutionError):
    """A file that belongs to the source is absent."""


class UnsupportedFormatError(SourceResolutionError):
    """The extension names no known format."""


class InvalidSourceError(SourceResolutionError):
    """The content of a source is malformed."""


class UnsupportedRepresentation(Exception):
    """The source has no such kind of values.

    ``counted`` holds the values per sample where those could be read, as statistics
    may still drop the variant.
    """

    def __init__(self, message: str, counted=None):
        super().__init__(message)
        self.counted = counted


class InvalidOptionError(ValueError):
    """An option has a value that isn't allowed."""


class MissingDataError(Exception):
    """Missing calls conflict with the missing-data policy."""


class SampleFilterError(Exception):
    """Requested samples aren't in the source, or aren't unique there."""


class InternalError(Exception):
    """An invariant of this library doesn't hold."""


#: Errors that are raised on executors carry their class in front of the message.
TAGGED = {c.__name__: c for c in (InvalidSourceError, UnsupportedRepresentation, MissingDataError, SampleFilterError, InternalError)}


def tag(kind: type[Exception], message: str) -> str:
    return f"[[{kind.__name__}]] {message}"


def untagged(error: BaseException) -> BaseException:
    """The error named in the message of one that came from an executor, or the error itself."""
    text = str(error)
    found = re.search(r"\[\[(\w+)\]\] ([^\n]*)", text) or re.search(r"lociframe\.errors\.(\w+): ([^\n]*)", text)
    if found and found[1] in TAGGED:
        return TAGGED[found[1]](found[2].strip())
    return error
