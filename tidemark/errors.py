"""Errors that callers may want to tell apart."""


class TidemarkError(Exception):
    """Base of all errors of the library."""


class ConfigurationError(TidemarkError):
    """A definition or option is wrong or incomplete."""


class ParseError(TidemarkError):
    """A text is no value of its type."""


class NoSuchEntityType(TidemarkError):
    """No entity type of that name."""


class NoSuchTrendStore(TidemarkError):
    """No trend store for that data source, entity type and granularity."""


class NoSuchTrend(TidemarkError):
    """No trend of that name."""


class NoSuchAttribute(TidemarkError):
    """No attribute of that name."""


class DuplicateDefinition(TidemarkError):
    """Something of that name is defined already."""


class DataTypeMismatch(TidemarkError):
    """Values do not fit the type of their column."""


#: Spark's error conditions and the error each means here.
CONDITIONS = {
    "TABLE_OR_VIEW_NOT_FOUND": NoSuchTrendStore,
    "PATH_NOT_FOUND": NoSuchTrendStore,
    "UNRESOLVED_COLUMN": NoSuchTrend,
    "CAST_INVALID_INPUT": DataTypeMismatch,
    "CAST_OVERFLOW": DataTypeMismatch,
    "NUMERIC_VALUE_OUT_OF_RANGE": DataTypeMismatch,
    "DATATYPE_MISMATCH": DataTypeMismatch,
    "USER_RAISED_EXCEPTION": ParseError,
    "TABLE_OR_VIEW_ALREADY_EXISTS": DuplicateDefinition,
    "TEMP_TABLE_OR_VIEW_ALREADY_EXISTS": DuplicateDefinition,
}


def translated(error: Exception) -> Exception:
    """The library's error for one of Spark's, by its condition; any other stays as it is."""
    condition = getattr(error, "getCondition", lambda: None)() or ""
    kind = CONDITIONS.get(condition.split(".")[0])
    return kind(str(error).splitlines()[0]) if kind else error
