"""References to notes and tests of paths, as Columns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from vaultspark.operators.predicates import glob_regex


def note_reference(reference: Column, known: list[str]) -> Column:
    """struct<vault, path, state> of a reference, vault:path or a path alone.

    state is 'plain' (no vault named, the path as it is but for blanks around it), 'ok' or, for a vault that isn't known,
    'bad_vault'. Web addresses, absolute paths and texts with a / before the colon name no vault. Slashes after the colon don't
    count. A null reference gives a null.
    """
    r = F.trim(reference)
    left = F.trim(F.substring_index(r, ":", 1))
    named = r.contains(":") & (left != "") & ~left.contains("/") & ~r.rlike(r"\A(?:https?://|/)")
    right = F.regexp_replace(F.substring(r, F.length(F.substring_index(r, ":", 1)) + 2, F.length(r)), r"\A/+", "")
    there = F.lit(False) if not known else left.isin(known)
    out = F.struct(F.when(named, left).alias("vault"), F.when(named, right).otherwise(r).alias("path"), F.when(~named, "plain").when(there, "ok").otherwise("bad_vault").alias("state"))
    return F.when(r.isNotNull(), out)


def note_uri(uri: Column) -> Column:
    """struct<vault, path> of note://vault/path; null for any other text."""
    ok = uri.rlike(r"\Anote://[^/]+/.+")
    return F.when(ok, F.struct(F.regexp_extract(uri, r"\Anote://([^/]+)/", 1).alias("vault"), F.regexp_extract(uri, r"(?s)\Anote://[^/]+/(.+)\z", 1).alias("path")))


def never_committed(path: Column, patterns: list[str]) -> Column:
    """Whether a path is one that is never committed.

    A pattern that ends with / names a folder from the root. Any other is a glob for the whole path, its name, or any end of it
    that begins after a /; * crosses folders, and a leading **/ may stand for nothing. Blank patterns match nothing, a null or
    empty path is none of them.
    """
    p = F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), r"\A(?:\./)+", "")
    test = F.lit(False)
    for given in patterns:
        g = given.strip().replace("\\", "/")
        if g.endswith("/"):
            folder = g.rstrip("/")
            test = test | (p == folder) | p.startswith(folder + "/")
        elif g:
            for glob in dict.fromkeys([g, g.removeprefix("**/")]):
                test = test | p.rlike(rf"(?s)\A(?:.*/)?(?:{_inner(glob)})\z")
    return F.coalesce((p != "") & test, F.lit(False))


def _inner(glob: str) -> str:
    """A glob's expression without its anchors and flags."""
    return re.sub(r"^(?:\(\?s\))?(?:\\A|\^)?(?:\(\?s\))?|(?:\\z|\$)$", "", glob_regex(glob))
