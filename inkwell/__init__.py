"""Inkwell: offline language-model annotation over large tables, on Spark."""

__version__ = "0.1.0"
