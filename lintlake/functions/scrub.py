"""Cleaning of text for terminals."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def scrub(text: Column) -> Column:
    """Without control characters other than tab, newline and carriage return. ESC goes too, so colour codes leave their rest behind."""
    return F.regexp_replace(text, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", "")


def strip_ansi(text: Column) -> Column:
    return F.regexp_replace(text, r"\x1b\[[0-9;]*m", "")
