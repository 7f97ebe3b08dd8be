"""Errors by code."""


class RedactionError(Exception):
    """``code`` is one of E_USAGE, E_UNSUPPORTED, E_COSMETIC_REFUSED, E_DANGLING, E_RANGE, E_CONFLICT, E_PARSE, E_LEAK."""

    def __init__(self, code: str, message: str, detail: dict | None = None):
        super().__init__(f"{code}: {message}")
        self.code, self.detail = code, detail or {}


class LeakError(RedactionError):
    def __init__(self, leaks: list):
        super().__init__("E_LEAK", f"{len(leaks)} removed values are still in the output", {"leaks": leaks})
        self.leaks = leaks
