"""From patterns and dictionary to documents.

A document's text is a version line, a dictionary line if there is one, a schema line and one
stream per column. A column that has a pattern is one operator; otherwise each value is a
reference or an escaped literal. If the text is not at least `threshold` times smaller than the
plain values, the document is written plain (`!ctx`).

Values that the format cannot carry literally (parentheses; texts that begin like a number or a
version but are none) get escapes of their own, and such a document says `!x1` (plain: `!xctx`)
instead of `!v1`. `compat=True` refuses to write them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colpattern.functions.text import escape, escape_dictionary, escape_name
from colpattern.operators import dictionary as D
from colpattern.operators.chunk import COLUMN_DDL, HEAD_DDL, arrow_pass
from colpattern.operators.detect import MIN_LENGTH, detect
from colpattern.storage import cut, maybe_broadcast

THRESHOLD = 1.2
#: Most bytes of values, names and separators that one document takes.
MAX_INPUT = 1 << 30
#: Numbers whose text survives being read as a number.
_PLAIN_NUMBER = r"^(0|-?[1-9][0-9]{0,17})\z|^-?(0|[1-9][0-9]{0,5})\.[0-9]{0,8}[1-9]\z|^-?[1-9][0-9]{0,8}\.[0-9]{0,5}[1-9]\z"


def unsafe(v: Column) -> Column:
    """Whether a value cannot stand literally in a stream."""
    return v.rlike(r"[()]") | (v.rlike(r"^[-!0-9]") & ~v.rlike(_PLAIN_NUMBER))


def literal(v: Column) -> Column:
    """A value as a stream token: escaped, and quoted where it is unsafe."""
    e = escape(v)
    quoted = F.concat(F.when(v.rlike(r"^[-!0-9]"), F.lit("\\q")).otherwise(""), F.regexp_replace(e, r"([()])", r"\\$1"))
    return F.when(unsafe(v), quoted).otherwise(e)


def operator_text(pattern: str = "pattern") -> Column:
    """The token of a detected pattern (columns of `detect`)."""
    usual = F.when(F.col("end") >= F.col("start"), 1).otherwise(-1)
    span = F.concat(F.col("start").cast("string"), F.lit(">"), F.col("end").cast("string"), F.when(F.col("step") == usual, "").otherwise(F.concat(F.lit(":"), F.col("step").cast("string"))))
    cycle = F.concat(F.array_join(F.transform("cycle", literal), "~"), F.lit("*"), F.col("period").cast("string"))
    times = F.concat(F.lit(")*"), F.col("repeats").cast("string"))
    p = F.col(pattern)
    return (
        F.when(p.isin("sequential", "arithmetic"), span)
        .when(p == "repeat", F.concat(literal(F.col("cycle")[0]), F.lit("*"), F.col("n").cast("string")))
        .when(p == "toggle", cycle)
        .when(p == "repeated_range", F.concat(F.lit("("), span, times))
        .when(p == "repeated_toggle", F.concat(F.lit("("), cycle, times))
    )


def choose(cells: DataFrame, keys: Sequence[str] = (), min_length: int = MIN_LENGTH) -> DataFrame:
    """detect() of each column with `operator`, the token of its pattern or null for a raw column."""
    found = detect(cells, [*keys, "col_idx"], min_length)
    return found.withColumn("operator", F.when((F.col("pattern") != "raw") & (F.col("ratio") > 1), operator_text()))


def _joined(df: DataFrame, keys: Sequence[str], token: Column, name: str) -> DataFrame:
    parts = F.transform(F.array_sort(F.collect_list(F.struct("rid", token.alias("token")))), lambda x: x["token"])
    return df.groupBy(*keys).agg(F.array_join(parts, " ").alias(name))


def size_model(cells: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(*keys, original_size): names once, and each value's bytes and a separator."""
    per = cells.groupBy(*keys, "col_idx", "col_name").agg(F.sum(F.octet_length("v") + 1).alias("b"))
    total = F.sum(F.col("b") + F.octet_length("col_name")).cast("long").alias("original_size")
    return per.groupBy(*keys).agg(total) if keys else per.agg(total)


def streams(cells: DataFrame, chosen: DataFrame, entries: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(*keys, col_idx, col_name, stream, plain, bad, pattern, dict_refs, raws, input_bytes, n): both
    forms of each column's stream."""
    by = [*keys, "col_idx"]
    coded = D.encode(cells, entries, keys)
    token = F.when(F.col("dict_idx").isNotNull(), F.concat(F.lit("_"), F.col("dict_idx").cast("string"))).otherwise(literal(F.col("v")))
    pair = F.transform(F.array_sort(F.collect_list(F.struct("rid", token.alias("a"), literal(F.col("v")).alias("b")))), lambda x: F.struct(x["a"], x["b"]))
    both = coded.groupBy(*by, "col_name").agg(pair.alias("p"), F.bool_or(unsafe(F.col("v"))).alias("bad"), F.count_if(F.col("dict_idx").isNotNull()).alias("refs"), F.count("*").alias("n"), F.sum(F.octet_length("v") + 1).alias("b"))
    out = both.join(chosen.select(*by, "operator", "pattern"), by)
    plain = F.array_join(F.transform("p", lambda x: x["b"]), " ")
    stream = F.coalesce("operator", F.array_join(F.transform("p", lambda x: x["a"]), " "))
    none = F.col("operator").isNull()
    return out.select(
        *by, "col_name", stream.alias("stream"), plain.alias("plain"), "bad", F.when(none, "raw").otherwise(F.col("pattern")).alias("pattern"), F.when(none, F.col("refs")).otherwise(0).cast("long").alias("dict_refs"),
        F.when(none, F.col("n") - F.col("refs")).otherwise(0).cast("long").alias("raws"), (F.col("b") + F.octet_length("col_name")).cast("long").alias("input_bytes"), "n",
    )


def sizes(cells: DataFrame, entries: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """What `column_stats` says of `streams`, for columns of any length: no stream is written, its bytes are
    added up. Only columns without a pattern are looked up in the dictionary."""
    by = [*keys, "col_name", "col_idx"]
    chosen = cut(choose(cells, by[:-1]))  # a row per column
    coded = D.encode(cells.join(maybe_broadcast(chosen.where("operator IS NULL").select(*by)), by, "left_semi"), entries, keys)
    size = F.when(F.col("dict_idx").isNotNull(), F.length(F.col("dict_idx").cast("string")) + 1).otherwise(F.octet_length(literal(F.col("v"))))
    raw = coded.groupBy(*by).agg((F.sum(size) + F.count("*") - 1).alias("_size"), F.count("dict_idx").alias("_refs"))
    none = F.col("operator").isNull()
    out = chosen.join(raw, by, "left").withColumn("output_bytes", F.when(none, F.col("_size")).otherwise(F.octet_length("operator")).cast("long"))
    source = F.col("bytes") + F.col("n") + F.octet_length("col_name")
    return _effect(out.select(
        *keys, "col_idx", "col_name", F.when(none, "raw").otherwise(F.col("pattern")).alias("pattern"), F.col("n").alias("value_count"), source.cast("long").alias("input_bytes"), "output_bytes",
        F.when(none, F.col("_refs")).otherwise(0).cast("long").alias("dict_refs"), F.when(none, F.col("n") - F.col("_refs")).otherwise(0).cast("long").alias("raws"),
    ))


def document_size(stats: DataFrame, entries: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(original_size, encoded_size, falls_back) of the one document that `documents` would write of a table of any
    length, from its `sizes` and dictionary."""
    names = F.sum(F.octet_length(escape_name(F.col("col_name"))) + 1) + F.count("*")
    body = stats.agg(F.sum("input_bytes").alias("original_size"), (4 + names + F.sum("output_bytes") + F.count("*") - 1).alias("_body"))
    words = entries.agg(F.coalesce(9 + F.sum(F.octet_length(escape_dictionary(F.col("v"))) + 1), F.lit(0)).alias("_words"))
    encoded = (F.col("_body") + F.col("_words")).alias("encoded_size")
    return body.crossJoin(words).select("original_size", encoded).withColumn("falls_back", F.col("original_size") / F.col("encoded_size") < threshold)


def documents(cells: DataFrame, keys: Sequence[str], threshold: float = THRESHOLD, min_length: int = MIN_LENGTH, max_entries: int = D.MAX_ENTRIES, compat: bool = False, max_input: int = MAX_INPUT) -> DataFrame:
    """(*keys, format, document, original_size, encoded_size, ratio, dictionary_entries, entries_used,
    columns) of each key's table; columns has a struct for each column.

    A document is one text, so one task writes it: chunk large tables by a key. cells:
    (*keys, col_idx, col_name, rid, kind, v), shuffled once by the keys and then seen by one Arrow pass.
    """
    names = ", ".join(f"`{k}` {cells.schema[k].dataType.simpleString()}" for k in keys)
    ready = cells.select(*keys, F.col("col_idx").cast("int").alias("col_idx"), "col_name", F.col("rid").cast("long").alias("rid"), "kind", "v")
    return ready.groupBy(*keys).applyInArrow(arrow_pass(list(keys), threshold, min_length, max_entries, compat, max_input), f"{names}, {HEAD_DDL}, columns array<{COLUMN_DDL}>")


def document_stats(docs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """What `column_stats` says, for the columns of `documents`."""
    return _effect(docs.select(*keys, F.explode("columns").alias("c")).select(*keys, "c.*"))


def _effect(stats: DataFrame) -> DataFrame:
    out = F.col("output_bytes")
    return stats.withColumns({"ratio": F.when(out > 0, F.col("input_bytes") / out).otherwise(0.0), "bytes_saved": F.col("input_bytes") - out, "was_compressed": out < F.col("input_bytes")})


def utilization(docs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(*keys, dictionary_entries, dictionary_utilization, dictionary_utilization_actual): 1 where a document has
    entries and its streams refer to any, else 0; and the share of the entries that they refer to."""
    entries, used = F.col("dictionary_entries"), F.col("entries_used")
    share = F.when(entries > 0, used / entries).otherwise(0.0)
    return docs.select(*keys, "dictionary_entries", F.when(used > 0, 1.0).otherwise(0.0).alias("dictionary_utilization"), share.alias("dictionary_utilization_actual"))


def column_stats(cols: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Per column of `streams`: bytes in and out, ratio, saved, pattern."""
    out = F.octet_length("stream").cast("long")
    return cols.select(
        *keys, "col_idx", "col_name", "pattern", F.col("n").alias("value_count"), "input_bytes", out.alias("output_bytes"), F.when(out > 0, F.col("input_bytes") / out).otherwise(0.0).alias("ratio"),
        (F.col("input_bytes") - out).alias("bytes_saved"), (out < F.col("input_bytes")).alias("was_compressed"), "dict_refs", "raws",
    )


def overall_stats(stats: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """The ten counters over column_stats (output_bytes is that of the streams)."""
    def times(*names: str) -> Column:
        return F.count_if(F.col("pattern").isin(*names))

    ranges, toggles = times("sequential", "arithmetic", "repeated_range"), times("toggle", "repeated_toggle")
    columns = [
        F.sum("input_bytes").alias("input_bytes"), F.sum("output_bytes").alias("output_bytes"), times("sequential", "arithmetic", "repeat", "toggle", "repeated_range", "repeated_toggle").alias("patterns_detected"),
        ranges.alias("ranges_used"), times("repeat", "repeated_range").alias("multipliers_used"), toggles.alias("toggles_used"), F.sum("dict_refs").alias("dict_refs_used"), F.sum("raws").alias("raw_values"),
        F.count("*").alias("columns_processed"), F.count_if("was_compressed").alias("columns_compressed"),
    ]
    out = stats.groupBy(*keys).agg(*columns) if keys else stats.agg(*columns)
    return out.withColumns({"ratio": F.when(F.col("output_bytes") > 0, F.col("input_bytes") / F.col("output_bytes")).otherwise(0.0), "column_effectiveness": F.when(F.col("columns_processed") > 0, F.col("columns_compressed") / F.col("columns_processed") * 100).otherwise(0.0)})


def report(stats: DataFrame) -> DataFrame:
    """(most_effective, least_effective, total_bytes_saved, compressed_columns): the most effective is
    of the compressed columns (ties: the last), the least of all (ties: the first)."""
    best = F.max_by(F.when(F.col("was_compressed"), F.col("col_name")), F.when(F.col("was_compressed"), F.struct("ratio", "col_idx")))
    worst = F.min_by("col_name", F.struct("ratio", "col_idx"))
    return stats.agg(best.alias("most_effective"), worst.alias("least_effective"), F.sum("bytes_saved").alias("total_bytes_saved"), F.count_if("was_compressed").alias("compressed_columns"))
