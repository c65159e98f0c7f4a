"""Column helpers shared by the operators; all stay inside the JVM."""
from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def any_literal(words) -> str:
    """Alternation that matches any of the given literal strings."""
    return "(?:" + "|".join(re.escape(w) for w in words) + ")"


def any_pattern(patterns) -> str:
    return "(?:" + "|".join(patterns) + ")"


def round_half_up(x: Column) -> Column:
    """Halves go towards plus infinity, as in the result format."""
    return F.floor(x + F.lit(0.5))


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def dirname(path: Column, root: str = "") -> Column:
    return F.when(F.instr(path, "/") > 0, F.regexp_extract(path, r"^(.*)/[^/]*\z", 1)).otherwise(F.lit(root))


def extension(path: Column) -> Column:
    """Last extension of the file name with its dot, lower-cased; empty when there is none."""
    return F.lower(F.regexp_extract(path, r"(\.[^./]*)\z", 1))


def depth(path: Column) -> Column:
    return F.length(path) - F.length(F.replace(path, F.lit("/"), F.lit(""))) + 1


def strip_ws(text: Column) -> Column:
    """Trim every kind of ASCII white space (``trim`` alone strips spaces only)."""
    return F.regexp_replace(text, r"^\s+|\s+\z", "")
