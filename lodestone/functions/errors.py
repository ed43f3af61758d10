"""Errors as the API's codes."""

from __future__ import annotations

#: Code by what an error's message contains.
MARKS = (("index_unavailable", ("locked", "busy")), ("embedder_unavailable", ("connection refused", "11434")))


class Refused(ValueError):
    """An input the API does not take."""


def classify(error: Exception) -> tuple[str, str]:
    """(code, message) of an error."""
    message = str(error)
    for code, marks in MARKS:
        if any(m in message.lower() for m in marks):
            return code, message
    return ("invalid_input" if isinstance(error, Refused) else "not_found" if isinstance(error, LookupError) else "internal_error"), message
