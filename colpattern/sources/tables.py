"""CSV, JSON, log lines and in-memory tables, in and out."""

from __future__ import annotations

import re
from collections.abc import Sequence
from itertools import groupby
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from colpattern.storage import cut, maybe_broadcast


_BLANK = " \t\r\n"


def detect_format(name: Column, content: Column) -> Column:
    """csv, json or document, by extension, else by how the content begins, else csv."""
    head = F.regexp_replace(content, r"^\s+", "")
    return (
        F.when(name.endswith(".csv"), "csv").when(name.endswith(".json"), "json").when(name.endswith(".colp"), "document")
        .when(head.rlike(r"^[\[{]"), "json").when(head.rlike(r"^(![vx]|!ctx|#|\$)"), "document").otherwise("csv")
    )


# ------------------------------------------------ CSV
def read_csv(spark: SparkSession, path: str, rid: str = "rid") -> DataFrame:
    """A CSV file with a header: all columns as text, with the row index. A row with too few or too many
    fields is an error. Quoted fields may hold line ends, so a file is one task's work."""
    df = spark.read.csv(path, header=True, inferSchema=False, mode="FAILFAST", multiLine=True, quote='"', escape='"', emptyValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return _numbered(df, rid)


def _numbered(df: DataFrame, rid: str) -> DataFrame:
    """df of files with its row index, in the order of files and their blocks: a block is read by one task in its
    order, so rows count on from the sizes of the blocks before, and none is sorted."""
    names, block = df.columns, ["_file", "_block"]
    at = cut(df.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_id")))
    sizes = at.groupBy(*block).agg(F.min("_id").alias("_first"), F.count("*").alias("_n"))  # a row per block
    before = sizes.select(*block, (F.sum("_n").over(Window.orderBy(*block)) - F.col("_n") - F.col("_first")).alias("_shift"))
    return at.join(F.broadcast(before), block).select(*[f"`{n}`" for n in names], (F.col("_id") + F.col("_shift")).alias(rid))


def csv_field(c: Column) -> Column:
    """A field, quoted where it has to be; null is nothing."""
    quoted = F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(c.isNull(), "").when(c.rlike(r'[",\n\r]'), quoted).otherwise(c)


def csv_lines(df: DataFrame, rid: str = "rid") -> DataFrame:
    """(rid, line) of each row; a single null column is written as `""`, so that the row survives."""
    names = [c for c in df.columns if c != rid]
    parts = [csv_field(F.col(f"`{c}`").cast("string")) for c in names]
    line = F.concat_ws(",", *parts)
    return df.select(rid, (F.when(line == "", '""').otherwise(line) if len(names) == 1 else line).alias("line"))


def write_csv(df: DataFrame, path: str, rid: str = "rid") -> None:
    """Write CSV files in row order, each with a header."""
    out = df.orderBy(rid).drop(rid)
    out = out.fillna("") if len(out.columns) == 1 and isinstance(out.schema[0].dataType, T.StringType) else out
    single = len(out.columns) == 1
    out.write.mode("overwrite").csv(path, header=True, nullValue="", emptyValue='""' if single else "", quote='"', escape='"')


# ------------------------------------------------ JSON
def exploded(df: DataFrame, column: str) -> DataFrame:
    """df with pos, key and value of every element of a column of JSON objects or arrays (variant)."""
    return df.lateralJoin(df.sparkSession.tvf.variant_explode(F.col(column).outer()))


def flatten(objects: DataFrame, keys: Sequence[str], column: str = "v") -> DataFrame:
    """(*keys, path, kind, v) of every leaf of a column of JSON objects (variant): nested objects give
    dotted paths, arrays stay JSON text. One pass per level of nesting; an empty object has no leaf."""
    level = objects.select(*keys, F.lit("").alias("prefix"), F.col(column).alias("v"))
    found = None
    while True:
        parts = exploded(level, "v").select(*keys, F.concat("prefix", "key").alias("path"), F.col("value").alias("v"), F.schema_of_variant("value").alias("t"))
        parts = cut(parts.withColumn("nested", F.col("t").startswith("OBJECT")))
        leaves = parts.where("not nested")
        found = leaves if found is None else found.unionByName(leaves)
        level = parts.where("nested").select(*keys, F.concat("path", F.lit(".")).alias("prefix"), "v")
        if level.isEmpty():
            break
    t = F.col("t")
    kind = F.when(t == "VOID", "null").when(t == "BIGINT", "integer").when(t.rlike("^(DOUBLE|FLOAT|DECIMAL)"), "float").when(t == "BOOLEAN", "boolean").otherwise("string")
    return found.select(*keys, "path", kind.alias("kind"), F.when(kind == "null", "\\0").otherwise(F.col("v").cast("string")).alias("v"))


class _Nesting:
    """How deep in brackets, and whether in a string, a JSON text is that comes in pieces, each up to a `}`."""

    def __init__(self, depth: int = 0, quoted: int = 0):
        self.depth, self.quoted = depth, quoted

    def piece(self, text: str, brace: bool) -> bool:
        """Take a piece and the brace behind it, if there is one; whether that ends a value of the outer array."""
        bare = _ESCAPED.sub("", text) if "\\" in text else text
        parts = bare.split('"')
        outside = "".join(parts[self.quoted :: 2])
        self.quoted = (self.quoted + len(parts) - 1) % 2
        self.depth += outside.count("{") + outside.count("[") - outside.count("]")
        if brace and not self.quoted:
            self.depth -= 1
            return self.depth == 1
        return False


_ESCAPED = re.compile(r"\\.", re.S)


def _by_block(batches):
    """(file, block, text, whether a brace follows) of pieces; those of a block come together."""
    for b in batches:
        yield from zip(*(b.column(c).to_pylist() for c in ("_file", "_block", "value", "_brace")), strict=True)


def _block_nesting(batches):
    """(file, block, quoted, depth, turned) of each block, for both states that it may begin in."""
    import pyarrow as pa

    for (file, block), pieces in groupby(_by_block(batches), lambda r: r[:2]):
        both = _Nesting(0, 0), _Nesting(0, 1)
        for _, _, text, brace in pieces:
            for n in both:
                n.piece(text, brace)
        yield pa.record_batch({"_file": [file] * 2, "_block": [block] * 2, "quoted": pa.array([0, 1], pa.int32()), "depth": pa.array([n.depth for n in both], pa.int32()), "turned": pa.array([n.quoted for n in both], pa.int32())})


def _elements(starts: dict[tuple[str, int], tuple[int, int, int]]):
    """The function for mapInArrow from pieces to (at, nth, ends, text): what of the outer array's values lies in a
    block; of the first and the last the rest may lie in others. starts: number and state of each block."""

    def run(batches):
        import pyarrow as pa

        def batch(rows):
            return pa.record_batch({k: pa.array(v, t) for (k, t), v in zip({"at": pa.int64(), "nth": pa.int64(), "ends": pa.bool_(), "text": pa.string()}.items(), zip(*rows, strict=True), strict=True)})

        for key, pieces in groupby(_by_block(batches), lambda r: r[:2]):
            at, depth, quoted = starts[key]
            state, nth, open_, out = _Nesting(depth, quoted), 0, [], []
            for _, _, text, brace in pieces:
                open_.append(text + "}" if brace else text)
                if state.piece(text, brace):
                    out.append((at, nth, True, "".join(open_)))
                    open_, nth = [], nth + 1
                    if len(out) == 10_000:
                        yield batch(out)
                        out = []
            yield batch([*out, (at, nth, False, "".join(open_))])

    return run


def write_json(df: DataFrame, path: str, rid: str = "rid", column: str = "json") -> None:
    """Write the objects of a column as one JSON array, in row order: the parts of the folder, one after the other, are
    its text. No task holds more than its part."""
    ends = df.agg(F.min(rid).alias("_a"), F.max(rid).alias("_b"))
    line = F.concat(F.when(F.col(rid) == F.col("_a"), "[").otherwise(","), F.col(column), F.when(F.col(rid) == F.col("_b"), "]").otherwise(""))
    df.crossJoin(F.broadcast(ends)).orderBy(rid).select(line.alias("value")).write.text(path)


def _objects(spark: SparkSession, path: str) -> DataFrame:
    """(rid, v) of the objects of an array. The text is read in pieces by many tasks, twice: how deep each block nests
    says where the objects of the next ones begin."""
    block = ["_file", "_block"]
    at = spark.read.option("lineSep", "}").text(path).select("value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_id"))
    at = cut(at)
    last = at.groupBy(*block).agg(F.max("_id").alias("_last")).groupBy("_file").agg(F.max_by("_last", "_block").alias("_last"))  # nothing follows the last piece of a file
    pieces = at.join(F.broadcast(last), "_file").select(*block, "value", (F.col("_id") != F.col("_last")).alias("_brace"))
    found = {(r["_file"], r["_block"], r["quoted"]): (r["depth"], r["turned"]) for r in pieces.mapInArrow(_block_nesting, "_file string, _block long, quoted int, depth int, turned int").collect()}  # two rows per block
    starts, depth, quoted = {}, 0, 0
    for k, (file, start) in enumerate(sorted({key[:2] for key in found})):
        starts[file, start] = k, depth, quoted
        more, quoted = found[file, start, quoted]
        depth += more
    parts = cut(pieces.mapInArrow(_elements(starts), "at long, nth long, ends boolean, text string"))
    sizes = parts.groupBy("at").agg(F.count_if("ends").alias("_n"))
    before = sizes.select("at", (F.sum("_n").over(Window.orderBy("at")) - F.col("_n")).alias("_before"))
    parts = parts.join(F.broadcast(before), "at").withColumn("rid", F.col("_before") + F.col("nth"))
    edge = (F.col("nth") == 0) | ~F.col("ends")
    joined = parts.where(edge).groupBy("rid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "nth", "text"))), lambda x: x["text"]), "").alias("text"), F.bool_or("ends").alias("ends"))
    rest = joined.where("NOT ends").select("rid", F.rtrim(F.col("text"), F.lit(_BLANK)).alias("text"), F.trim(F.substring("text", 1, 1000)).alias("head")).first()
    if rest and re.sub(r"\s", "", rest["text"]) not in (("", "[]") if rest["rid"] == 0 else ("]",)):
        first = rest["head"].lstrip()[:1] if rest["rid"] == 0 else "["
        raise ValueError("the document is not an array" if first != "[" else "the array holds something else than objects, or does not end")
    whole = parts.where(~edge).select("rid", "text").unionByName(joined.where("ends").select("rid", "text"))
    begun = F.when(F.col("rid") == 0, F.col("text").rlike(r"^\s*\[\s*\{")).otherwise(F.col("text").rlike(r"^\s*,\s*\{"))
    text = F.regexp_replace("text", r"^\s*[\[,]\s*", "")
    return whole.select("rid", F.when(begun, F.parse_json(text)).otherwise(F.raise_error(F.lit("the array holds something else than objects")).cast("variant")).alias("v"))


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """Cells (col_name, rid, kind, v) of a file that holds an array of objects, or of a folder whose files one after the
    other do. Keys that a row lacks are null; anything but an array of objects is an error."""
    rows = cut(_objects(spark, path))
    cells = flatten(rows, ["rid"]).withColumnRenamed("path", "col_name")
    names = sorted(r["col_name"] for r in cells.select("col_name").distinct().collect())  # the columns of the table
    if not names:
        return cells.select("col_name", "rid", "kind", "v")
    grid = rows.select("rid", F.explode(F.array(*map(F.lit, names))).alias("col_name"))
    return grid.join(cells, ["rid", "col_name"], "left").select("col_name", "rid", F.coalesce("kind", F.lit("null")).alias("kind"), F.coalesce("v", F.lit("\\0")).alias("v"))


def with_column_index(cells: DataFrame) -> DataFrame:
    """cells with col_idx, columns in order of their names (as JSON tables have them)."""
    names = cells.select("col_name").distinct().withColumn("col_idx", F.row_number().over(Window.orderBy("col_name")) - 1)
    return cells.join(maybe_broadcast(cut(names)), "col_name")


def json_rows(df: DataFrame, rid: str = "rid") -> DataFrame:
    """(rid, json): each row as an object; dotted names become nested objects, numbers that are not
    finite become null. A name that is also the prefix of another is an error."""
    tree: dict[str, Any] = {}
    for f in df.schema.fields:
        if f.name == rid:
            continue
        at, parts = tree, f.name.split(".")
        for p in parts[:-1]:
            at = at.setdefault(p, {})
            if not isinstance(at, dict):
                raise ValueError(f"{f.name}: a value and an object have the same name")
        if parts[-1] in at:
            raise ValueError(f"{f.name}: a value and an object have the same name")
        c = F.col(f"`{f.name}`")
        at[parts[-1]] = F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c) if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else c

    def build(node: dict[str, Any]) -> Column:
        return F.struct(*[(build(v) if isinstance(v, dict) else v).alias(k) for k, v in node.items()])

    return df.select(rid, F.to_json(build(tree), {"ignoreNullFields": "false"}).alias("json"))


def json_array(df: DataFrame, rid: str = "rid") -> str:
    """The whole table as one JSON array (gathered on the driver; for small tables)."""
    return "[" + ",".join(r["json"] for r in json_rows(df, rid).orderBy(rid).collect()) + "]"


# ------------------------------------------------ log lines, memory
def read_lines(spark: SparkSession, path: str, rid: str = "rid") -> DataFrame:
    """(line, rid) of a text file or folder, in file order."""
    return _numbered(spark.read.text(path).withColumnRenamed("value", "line"), rid)


def from_pandas(spark: SparkSession, pdf, rid: str = "rid") -> DataFrame:
    """A pandas table with its row index."""
    return spark.createDataFrame(pdf.assign(**{rid: range(len(pdf))}))


def from_array(spark: SparkSession, array, names: Sequence[str] | None = None, rid: str = "rid") -> DataFrame:
    """A two-dimensional numpy array; columns are col0, col1 ... unless named."""
    import pandas as pd

    if array.ndim != 2:
        raise ValueError("the array must have two dimensions")
    names = list(names or [f"col{i}" for i in range(array.shape[1])])
    if len(names) != array.shape[1]:
        raise ValueError(f"{len(names)} names for {array.shape[1]} columns")
    return from_pandas(spark, pd.DataFrame(array, columns=names), rid)
