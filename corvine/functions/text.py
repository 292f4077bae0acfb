"""Column expressions over text: nothing here leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def lines(text: Column) -> Column:
    """Lines between newlines, trailing empty ones kept."""
    return F.split(text, "\n", -1)


def strip(text: Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def identifier_tokens(text: Column) -> Column:
    """Lower-cased ASCII letter-digit runs, split where a capital follows a small letter or a digit."""
    # Capitals, then small letters and digits: without looking around, which takes eight times as long.
    return F.transform(F.regexp_extract_all(text, F.lit("[A-Z]*+[a-z0-9]+|[A-Z]+"), F.lit(0)), F.lower)


def line_density(text: Column, prefix: str) -> Column:
    """struct(ratio, n): share of the non-blank lines that begin, once stripped, with ``prefix``, and their number."""
    full = F.filter(lines(text), lambda x: x.rlike(r"(?U)\S"))
    marked = F.filter(full, lambda x: F.regexp_replace(x, r"(?U)^\s+", "").startswith(prefix))
    n = F.size(full)
    return F.struct(F.when(n > 0, F.size(marked) / n).otherwise(0.0).alias("ratio"), n.alias("n"))


# Fixed value: what follows a text that was cut.
MARKER = ("\t/* ... truncated ... */", "}")


def head_lines(text: Column, most: int, marker: tuple[str, ...] = MARKER) -> Column:
    """The first ``most`` lines and the marker lines where there are more."""
    parts = lines(text)
    return F.when(F.size(parts) > most, F.array_join(F.concat(F.slice(parts, 1, most), F.array(*map(F.lit, marker))), "\n")).otherwise(text)


def subsystem(path: Column) -> Column:
    """The first two components of a path, or the only one."""
    return F.array_join(F.slice(F.split(path, "/"), 1, 2), "/")


def snippet(code: Column, chars: int = 96) -> Column:
    """The beginning of the first line."""
    return F.substring(F.split(code, "\n")[0], 1, chars)


def md5_number(text: Column, digits: int = 15) -> Column:
    """The first hex digits of the MD5 as a number: evenly spread and the same in every engine."""
    return F.conv(F.substring(F.md5(text), 1, digits), 16, 10).cast("long")


def in_validation(path: Column, fraction: float) -> Column:
    """Deterministic split by the path alone, in steps of a millionth."""
    return md5_number(path) % 1_000_000 < int(fraction * 1_000_000)


def metric_name(key: Column) -> Column:
    """What follows the last underscore, lower-cased."""
    return F.lower(F.element_at(F.split(key, "_"), -1))


def is_reported(key: Column) -> Column:
    """Whether a key names a retrieval metric at all."""
    return F.lower(key).rlike("accuracy|mrr|ndcg|recall")
