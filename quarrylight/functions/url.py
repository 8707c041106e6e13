"""URL expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Suffixes of two labels under which names are registered.
TWO_LABEL_SUFFIXES = ("co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "co.nz", "co.example", "clinic.example")


def host(c: Column | str) -> Column:
    """The host in lower case, without a port; empty if there is none."""
    return F.lower(F.regexp_extract(c, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@]*@)?([^/:?#]+)", 1))


def path(c: Column | str) -> Column:
    """The path, ``/`` at least."""
    p = F.regexp_extract(c, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    return F.when(p == "", "/").otherwise(p)


def registrable(h: Column) -> Column:
    """The registered name of a host: two labels, or three under a suffix of two."""
    two, three = F.substring_index(h, ".", -2), F.substring_index(h, ".", -3)
    return F.when(two.isin(*TWO_LABEL_SUFFIXES), three).otherwise(two)


def stem(h: Column) -> Column:
    """The registered label."""
    return F.substring_index(registrable(h), ".", 1)


def key(c: Column | str) -> Column:
    """What two addresses of one page share: host without ``www``, path without a closing slash, no query."""
    return F.concat(F.regexp_replace(host(c), r"^www\.", ""), F.regexp_replace(path(c), "/+$", ""))


def segments(c: Column | str) -> Column:
    return F.filter(F.split(F.lower(path(c)), "[^a-z0-9]+"), lambda x: x != "")


def has_run(tokens: Column, need: list[str]) -> Column:
    """Whether the path tokens hold the needed ones in a row."""
    n, want = len(need), F.array(*map(F.lit, need))
    return F.when(F.size(tokens) >= n, F.exists(F.sequence(F.lit(1), F.greatest(F.size(tokens) - n + 1, F.lit(1))), lambda i: F.slice(tokens, i, n) == want)).otherwise(False)
