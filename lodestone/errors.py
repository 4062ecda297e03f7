"""Errors of the engine. A session turns them into failed results; the layers below raise them."""


class EngineError(Exception):
    """Anything a statement can be refused for."""


class ParseError(EngineError):
    def __init__(self, message: str, line: int, column: int) -> None:
        super().__init__(f"line {line}, column {column}: {message}")
        self.line, self.column = line, column


class ConstraintError(EngineError):
    """A statement would break a constraint; nothing of it has been applied."""


class SerializationError(EngineError):
    """A commit conflicts with one that came first."""
