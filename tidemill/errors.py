"""Failures that a run or its authoring can report."""

from __future__ import annotations


class DataflowError(Exception):
    """A run failed."""


class BufferOverflowError(DataflowError): ...


class CollectOverflowError(DataflowError): ...


class TrackedKeyOverflowError(DataflowError): ...


class RateLimitExceededError(DataflowError): ...


class StreamTimeoutError(DataflowError): ...


class EmptyStreamError(DataflowError): ...


class RouteOutOfRangeError(DataflowError): ...


class SourceFailedError(DataflowError): ...


class CheckpointConflictError(DataflowError): ...


class PipelineRejectedError(DataflowError): ...


class PipelineResumeRefusedError(DataflowError): ...


class GraphDocumentFormatError(DataflowError): ...


class UnboundedSourceError(DataflowError): ...


#: By the code that a failing row carries to the terminal.
BY_CODE = {c.__name__: c for c in (BufferOverflowError, CollectOverflowError, TrackedKeyOverflowError, RateLimitExceededError, StreamTimeoutError, EmptyStreamError, RouteOutOfRangeError, SourceFailedError)}


def raise_coded(text: str) -> None:
    code, _, message = text.partition(": ")
    raise BY_CODE.get(code, DataflowError)(message or text)
