"""Operators on DataFrames: batching, validation, dictionaries, variants, comparison."""
