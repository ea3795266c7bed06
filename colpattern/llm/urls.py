"""URL filter with a weighted vocabulary: strict terms reject at once, soft ones in numbers.

One Aho-Corasick automaton finds all terms of a URL in one pass. A hit counts when it stands
between boundaries: the characters beside it are not ASCII letters or digits (so "ads" is in
"ads-track" but not in "leads"). The vocabulary is a file, whose path is a parameter of `load`. A URL is rejected on `strict` hits of strict terms or on
`soft` *distinct* soft terms.

Defined results: matching ignores the case of ASCII letters and takes the URL as it is written (nothing is decoded);
a null or empty URL has no hits and is kept; repeated rows are judged alike; rows with a null
page_id are judged too; an empty table gives an empty result. A term that is both strict and
soft is strict. Terms are runs of ASCII letters and digits.
"""

from __future__ import annotations

import re
import string
from collections.abc import Sequence
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The default vocabulary: a term and its kind, strict or soft, on each line.
VOCABULARY = Path(__file__).with_name("url_terms.txt")


def load(path: str | Path = VOCABULARY) -> tuple[tuple[str, ...], tuple[str, ...]]:
    """(strict terms, soft terms) of a file with `term kind` lines; # begins a comment."""
    terms: dict[str, list[str]] = {"strict": [], "soft": []}
    for line in Path(path).read_text().splitlines():
        words = line.partition("#")[0].split()
        if words:
            if len(words) != 2 or words[1] not in terms:
                raise ValueError(f"not a term and its kind: {line}")
            terms[words[1]].append(words[0])
    return tuple(terms["strict"]), tuple(terms["soft"])


STRICT, SOFT = load()
#: Strict hits, and distinct soft terms, that reject a URL.
STRICT_HITS, SOFT_TERMS = 1, 2

RESULT = "struct<strict_hits:bigint,soft_hits:bigint,soft_terms:bigint>"
_RESULT = pa.struct([("strict_hits", pa.int64()), ("soft_hits", pa.int64()), ("soft_terms", pa.int64())])


def automaton(strict: Sequence[str], soft: Sequence[str]):
    import ahocorasick

    words = {w.lower(): (k, False) for k, w in enumerate(soft)} | {w.lower(): (-1, True) for w in strict}
    if bad := [w for w in words if not re.fullmatch("[a-z0-9]+", w)]:
        raise ValueError(f"terms must be letters and digits: {bad}")
    a = ahocorasick.Automaton()
    for w, (k, hard) in words.items():
        a.add_word(w, (len(w), k, hard))
    if words:
        a.make_automaton()
    return a if words else None


def _inside(c: str) -> bool:
    return c.isascii() and c.isalnum()


def count(url: str | None, a) -> tuple[int, int, int]:
    """(strict hits, soft hits, distinct soft terms) of a URL."""
    if not url or a is None:
        return 0, 0, 0
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in url) if not url.isascii() else url.lower()
    hard, terms = 0, []
    for end, (n, k, strict) in a.iter(text):
        if (end + 1 < len(text) and _inside(text[end + 1])) or (end >= n and _inside(text[end - n])):
            continue
        if strict:
            hard += 1
        else:
            terms.append(k)
    return hard, len(terms), len(set(terms))


def count_udf(strict: Sequence[str] = STRICT, soft: Sequence[str] = SOFT):
    a = automaton(strict, soft)

    def counts(urls: pa.Array) -> pa.Array:
        rows = np.array([count(u, a) for u in urls.to_pylist()], np.int64).reshape(-1, 3)
        return pa.StructArray.from_arrays([pa.array(rows[:, k]) for k in range(3)], fields=list(_RESULT))

    return F.arrow_udf(counts, RESULT)


def judge(pages: DataFrame, strict: Sequence[str] = STRICT, soft: Sequence[str] = SOFT, strict_hits: int = STRICT_HITS, soft_terms: int = SOFT_TERMS) -> DataFrame:
    """(page_id, url, strict_hits, soft_hits, soft_terms, keep) of each row; only the URL column is read."""
    got = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"))
    got = got.withColumn("r", count_udf(strict, soft)("url")).select("page_id", "url", "r.strict_hits", "r.soft_hits", "r.soft_terms")
    return got.withColumn("keep", (F.col("strict_hits") < strict_hits) & (F.col("soft_terms") < soft_terms))


def judge_sql(strict: Sequence[str] = STRICT, soft: Sequence[str] = SOFT, strict_hits: int = STRICT_HITS, soft_terms: int = SOFT_TERMS) -> str:
    """The same in DuckDB SQL: between boundaries, a hit is a whole run of letters and digits."""
    hard, mild = ", ".join(f"'{w}'" for w in strict), ", ".join(f"'{w}'" for w in soft if w not in strict)
    return f"""
        WITH t AS (SELECT page_id, url, string_split_regex(translate(coalesce(url, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '[^a-z0-9]+') AS w FROM pages),
        c AS (SELECT page_id, url, len(list_filter(w, lambda x: x IN ({hard})))::BIGINT AS strict_hits,
                     len(list_filter(w, lambda x: x IN ({mild})))::BIGINT AS soft_hits,
                     len(list_distinct(list_filter(w, lambda x: x IN ({mild}))))::BIGINT AS soft_terms FROM t)
        SELECT page_id, url, strict_hits, soft_hits, soft_terms,
               strict_hits < {strict_hits} AND soft_terms < {soft_terms} AS keep FROM c"""
