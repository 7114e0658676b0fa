"""Data-agnostic DataFrame operators: column names are arguments."""
