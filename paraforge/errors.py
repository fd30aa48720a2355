"""The errors of the contract, and their counterparts among Spark's error conditions."""

from __future__ import annotations


class ParquetContractError(OSError):
    """Base of all errors of this library."""


class UnsupportedTypeError(ParquetContractError):
    """A type outside the contract."""


class UnsupportedNestedEncodingError(ParquetContractError):
    """A list, map or repeated field whose encoding the contract does not resolve."""


class InputSchemaMismatchError(ParquetContractError):
    """Data that do not have the schema that the writer was given."""


class InvalidValueError(ParquetContractError):
    """A value, dictionary index or map key that the contract rejects on writing."""


class InvalidFileError(ParquetContractError):
    """A file or footer that can't be opened, or a projection that names nothing in it."""


class CorruptFileError(ParquetContractError):
    """Pages that can't be decoded, or stored maps with repeated keys."""


class MetadataSchemaMismatchError(ParquetContractError):
    """A stored value outside the range that its annotation allows."""


class MetadataLimitError(ParquetContractError):
    """A schema hint beyond its limits."""


class CodecUnavailableError(ParquetContractError):
    """A codec outside the contract."""


class ReadEngineUnavailableError(ParquetContractError):
    """A read engine that is named but not there."""


class ReaderPoisonedError(ParquetContractError):
    """A reader that is used after it has failed."""


class WriterAbortedError(ParquetContractError):
    """A writer that is used after it has failed while writing."""


class PathExistsError(ParquetContractError):
    """A target that exists already."""


#: What the messages of failing reads begin with.
OUTSIDE_ANNOTATION, BAD_STORED_KEYS = "a stored value is outside its annotation:", "a stored map has null, repeated or unsupported keys:"

_BY_CONDITION = (
    (OUTSIDE_ANNOTATION, MetadataSchemaMismatchError),
    (BAD_STORED_KEYS, CorruptFileError),
    ("PARQUET_TYPE_ILLEGAL", UnsupportedTypeError),
    ("PARQUET_TYPE_NOT_SUPPORTED", UnsupportedTypeError),
    ("UNSUPPORTED_DATA_TYPE_FOR_DATASOURCE", UnsupportedTypeError),
    ("EMPTY_SCHEMA_NOT_SUPPORTED_FOR_DATASOURCE", UnsupportedTypeError),
    ("COLUMN_ALREADY_EXISTS", UnsupportedTypeError),
    ("DUPLICATED_MAP_KEY", InvalidValueError),
    ("USER_RAISED_EXCEPTION", InvalidValueError),
    ("ARITHMETIC_OVERFLOW", InvalidValueError),
    ("NUMERIC_VALUE_OUT_OF_RANGE", InvalidValueError),
    ("UNRESOLVED_COLUMN", InvalidFileError),
    ("PATH_ALREADY_EXISTS", PathExistsError),
    ("UNABLE_TO_INFER_SCHEMA", InvalidFileError),
    ("PATH_NOT_FOUND", InvalidFileError),
    ("CANNOT_READ_FILE_FOOTER", InvalidFileError),
    ("FAILED_READ_FILE", CorruptFileError),
)


def translate(error: BaseException) -> BaseException:
    """The contract's error for one of Spark's, with the cause kept; others, memory errors among them, as they are."""
    if isinstance(error, ParquetContractError | MemoryError):
        return error
    text = f"{getattr(error, 'getCondition', lambda: '')() or ''} {error}"
    told = str(error).split("\n", 1)[0]
    if "not a Parquet file" in text or "expected magic number" in text or "corrupted file: the footer" in text:
        kind: type[ParquetContractError] | None = InvalidFileError
    else:
        condition, kind = next(((c, kind) for c, kind in _BY_CONDITION if c in text), ("", None))
        if condition in (OUTSIDE_ANNOTATION, BAD_STORED_KEYS):
            told = text[text.index(condition) :].split("\n", 1)[0]
    if kind is None:
        return error
    out = kind(told)
    out.__cause__ = error
    return out
