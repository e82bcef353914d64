"""What can stop a conversion: one class for each cause, raised where the cause is found, with what a user can do."""

from __future__ import annotations


class ConversionError(Exception):
    """The base of all causes; ``advice`` may be empty."""

    advice = ""

    def told(self) -> str:
        """The message with the advice."""
        return f"{self}. {self.advice}" if self.advice else str(self)


class SourceError(ConversionError, ValueError):
    """The file is not what its name says, or parts of it are missing."""

    advice = "Export the scene again, or check that the copy is complete."


class UnsupportedSource(SourceError, NotImplementedError):
    """The file may be right, but this engine does not read its kind."""

    advice = "Little-endian PLY, SPLAT and SPZ up to version 3 are read."


class EmptyScene(ConversionError, ValueError):
    """No Gaussian is left to convert."""

    advice = "Use a lower opacity threshold or a wider crop box."


class GridTooLarge(ConversionError, ValueError):
    """The dense grid passes its limit."""

    advice = "Choose a lower resolution, a crop box, or slab mode."


class OutOfMemory(ConversionError):
    """An executor or the driver had too little memory."""

    advice = "Choose slab mode, more shuffle partitions, or larger executors."


class Cancelled(ConversionError):
    """Somebody has cancelled the request."""


class NotReady(ConversionError, RuntimeError):
    """A request came before the one that it needs."""


def cause_of(error: BaseException, cancelled: bool = False) -> BaseException:
    """The error as one of these classes where its cause is known from the request (``cancelled``) or from the classes of
    the errors that led to it, in Python or in the JVM; otherwise itself."""
    if cancelled:
        return Cancelled("the request was cancelled")
    seen: BaseException | None = error
    while seen is not None:
        if isinstance(seen, ConversionError):
            return seen
        if isinstance(seen, MemoryError) or any(kind.endswith("OutOfMemoryError") for kind in _jvm_classes(seen)):
            return OutOfMemory("the conversion ran out of memory")
        seen = seen.__cause__
    return error


def _jvm_classes(error: BaseException) -> list[str]:
    """Names of the classes of a JVM error and of what caused it."""
    out, java = [], getattr(error, "java_exception", None) or getattr(error, "_origin", None)
    while java is not None and len(out) < 50:
        out.append(java.getClass().getName())
        java = java.getCause()
    return out
