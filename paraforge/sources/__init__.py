"""Reading and writing Parquet under the contract."""

from .footer import file_facts
from .reader import Reader, ReadOptions, read
from .writer import WriteOptions, write

__all__ = ["ReadOptions", "Reader", "WriteOptions", "file_facts", "read", "write"]
