"""Errors of the engine, by the step that raised them, with a code for what went wrong."""

from __future__ import annotations


class EngineError(Exception):
    def __init__(self, code: str, message: str):
        super().__init__(f"{code}: {message}")
        self.code, self.message = code, message


class ParserError(EngineError):
    def __init__(self, message: str):
        super().__init__("Syntax", message)


class BinderError(EngineError):
    pass


class ExecutionError(EngineError):
    pass


_CONDITIONS = {
    "ARITHMETIC_OVERFLOW": "NumericOverflow",
    "BINARY_ARITHMETIC_OVERFLOW": "NumericOverflow",
    "CAST_OVERFLOW": "NumericOverflow",
    "DIVIDE_BY_ZERO": "DivisionByZero",
    "REMAINDER_BY_ZERO": "DivisionByZero",
    "INTERVAL_DIVIDED_BY_ZERO": "DivisionByZero",
    "CAST_INVALID_INPUT": "CastFailed",
    "USER_RAISED_EXCEPTION": "InvalidType",
}


def from_spark(error: Exception) -> ExecutionError:
    """The engine's error for one that Spark raised while it ran a statement."""
    text = str(error)
    condition = (getattr(error, "getCondition", lambda: None)() or "").split(".")[0]
    code = _CONDITIONS.get(condition) or next((v for k, v in _CONDITIONS.items() if f"[{k}" in text), "Internal")
    return ExecutionError(code, text.splitlines()[0] if text else type(error).__name__)
