"""What can go wrong, besides ValueError for bad definitions and LookupError for unknown names."""


class SqlError(ValueError):
    """Any fault of a statement."""


class _Placed(SqlError):
    kind = ""

    def __init__(self, line: int, column: int, message: str):
        super().__init__(f"SQL {self.kind} error at {line}:{column}: {message}")
        self.line, self.column, self.message = line, column, message


class SqlLexError(_Placed):
    kind = "lex"


class SqlParseError(_Placed):
    kind = "parse"


class SqlBindError(SqlError):
    """A statement that does not fit the catalog."""


class CorruptionError(RuntimeError):
    """Stored state that contradicts itself."""


class CatalogCorruption(CorruptionError):
    pass


class TableCorruption(CorruptionError):
    pass


class IndexCorruption(CorruptionError):
    pass
