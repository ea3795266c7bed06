"""Operators and their expansion, documents, log lines and chunks."""

from __future__ import annotations

from pyspark.sql import functions as F

from colpattern.catalog import inputs as I
from colpattern.catalog.registry import query, table
from colpattern.operators import expand as X
from colpattern.operators import syslog as L
from colpattern.plans import codec
from colpattern.sources import document as Doc
from colpattern.sources import tables as T
from colpattern.storage import fresh_path
from colpattern.streaming import chunks

# ------------------------------------------------ operators derived from part
_START, _END, _STEP, _REP = "p_size", "p_size + p_partkey % 20 * CASE WHEN p_partkey % 2 = 0 THEN 1 ELSE -1 END", "(1 + p_partkey % 3) * CASE WHEN p_partkey % 2 = 0 THEN 1 ELSE -1 END", "1 + p_partkey % 2"


def _ops(spark, sf):
    """Two streams per part: a range, a toggle, a reference and a literal; and a range as long as they."""
    p = table(spark, sf, "part").withColumns({"s": F.expr(_START).cast("long"), "e": F.expr(_END).cast("long"), "st": F.expr(_STEP).cast("long"), "r": F.expr(_REP).cast("long")})
    null = F.lit(None)

    def op(col, i, kind, repeats, text=null, start=null, end=null, step=null, values=null, count=null, ref=null):
        return F.struct(F.lit(col).alias("col_idx"), F.lit(i).alias("op_idx"), F.lit(kind).alias("kind"), F.lit(repeats).cast("long").alias("repeats") if isinstance(repeats, int) else repeats.alias("repeats"), text.cast("string").alias("text"), start.cast("long").alias("start"), end.cast("long").alias("end"), step.cast("long").alias("step"), values.cast("array<string>").alias("values"), count.cast("long").alias("count"), ref.cast("long").alias("dict_idx"))

    span = F.expr("(abs(e - s) DIV abs(st) + 1) * r")
    items = F.array(
        op(0, 0, "range", F.col("r"), start=F.col("s"), end=F.col("e"), step=F.col("st")), op(0, 1, "toggle", 1, values=F.array("p_brand", "p_type"), count=F.lit(3)), op(0, 2, "dict", 1, ref=F.col("p_partkey") % 2), op(0, 3, "raw", 2, text=F.col("p_name")),
        op(1, 0, "range", 1, start=F.lit(1), end=span + F.when(F.col("p_partkey") % 5 == 0, 5).otherwise(6), step=F.lit(1)),
    )
    return p.select("p_partkey", F.array("p_name", "p_type").alias("dictionary"), F.explode(items).alias("x")).select("p_partkey", "dictionary", "x.*")


_OPS = f"o AS (SELECT p_partkey, p_name, p_brand, p_type, ({_START})::BIGINT AS s, ({_END})::BIGINT AS e, ({_STEP})::BIGINT AS st, ({_REP})::BIGINT AS r FROM part), b AS (SELECT *, abs(e - s) // abs(st) + 1 AS base FROM o)"
_VALUES = f"""{_OPS}, v AS (SELECT p_partkey, 0 AS col_idx, 0 AS op_idx, unnest(range(base * r)) AS j, base, s, st, NULL AS t FROM b
    UNION ALL SELECT p_partkey, 0, 1, unnest(range(3)), 0, 0, 0, p_brand || '~' || p_type FROM b UNION ALL SELECT p_partkey, 0, 2, 0, 0, 0, 0, CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE p_type END FROM b
    UNION ALL SELECT p_partkey, 0, 3, unnest(range(2)), 0, 0, 0, p_name FROM b UNION ALL SELECT p_partkey, 1, 0, unnest(range(base * r + CASE WHEN p_partkey % 5 = 0 THEN 5 ELSE 6 END)), 1000000000, 1, 1, NULL FROM b),
    x AS (SELECT p_partkey, col_idx, op_idx, j, CASE WHEN t IS NULL THEN CAST(s + (j % base) * st AS VARCHAR) WHEN op_idx = 1 THEN split_part(t, '~', (j % 2 + 1)::INT) ELSE t END AS v FROM v),
    w AS (SELECT p_partkey, col_idx, row_number() OVER (PARTITION BY p_partkey, col_idx ORDER BY op_idx, j) - 1 AS rid, op_idx, v FROM x)"""


def _expanded(spark, sf, kind: str | None = None, col: int = 0):
    ops = _ops(spark, sf).where(F.col("col_idx") == col)
    ops = ops if kind is None else ops.where(F.col("kind") == kind)
    return X.expand(ops, ["p_partkey"], "dictionary")


@query("range_count", f"WITH {_OPS} SELECT p_partkey, (abs(e - s) // abs(st) + 1)::DOUBLE AS claimed, CASE WHEN (e >= s) = (-st > 0) THEN abs(e - s) // abs(st) + 1 ELSE 1 END::DOUBLE AS reversed FROM o")
def range_count(spark, sf):
    """What a range claims; with the step turned around the direction does not fit and it claims 1."""
    o = _ops(spark, sf).where("kind = 'range' AND col_idx = 0")
    s, e, st = F.col("start"), F.col("end"), F.col("step")
    return o.where(X.check_range(s, e, st)).select("p_partkey", X.range_count(s, e, st).cast("double").alias("claimed"), X.range_count(s, e, -st).cast("double").alias("reversed"))


@query("expand_range", f"WITH {_VALUES}, q AS (SELECT p_partkey, v, row_number() OVER (PARTITION BY p_partkey ORDER BY j) - 1 AS rid FROM x JOIN b USING (p_partkey) WHERE col_idx = 0 AND op_idx = 0 AND j < base) SELECT p_partkey, rid, v FROM q")
def expand_range(spark, sf):
    ops = _ops(spark, sf).where("kind = 'range' AND col_idx = 0").withColumn("repeats", F.lit(1).cast("long"))
    return X.expand(ops, ["p_partkey"], "dictionary").select("p_partkey", "rid", "v")


@query("expand_multiply", f"WITH {_VALUES} SELECT p_partkey, rid, v FROM w WHERE col_idx = 0 AND op_idx = 0")
def expand_multiply(spark, sf):
    return _expanded(spark, sf, "range").select("p_partkey", "rid", "v")


@query("expand_toggle", f"WITH {_VALUES} SELECT p_partkey, j AS rid, v FROM x WHERE col_idx = 0 AND op_idx = 1")
def expand_toggle(spark, sf):
    return _expanded(spark, sf, "toggle").select("p_partkey", "rid", "v")


@query("expand_dictref", f"WITH {_VALUES} SELECT p_partkey, j AS rid, v FROM x WHERE col_idx = 0 AND op_idx = 2")
def expand_dictref(spark, sf):
    return _expanded(spark, sf, "dict").select("p_partkey", "rid", "v")


@query("expanded_count", f"WITH {_VALUES} SELECT p_partkey, col_idx, count(*) AS n FROM w GROUP BY p_partkey, col_idx")
def expanded_count(spark, sf):
    return _ops(spark, sf).groupBy("p_partkey", "col_idx").agg(F.sum(X.expanded_count()).alias("n"))


@query("expand_stream", f"WITH {_VALUES} SELECT p_partkey, rid, v FROM w WHERE col_idx = 0")
def expand_stream(spark, sf):
    return _expanded(spark, sf).select("p_partkey", "rid", "v")


@query("document_validate", f"WITH {_VALUES}, n AS (SELECT p_partkey, col_idx, count(*) AS n FROM w GROUP BY p_partkey, col_idx) SELECT p_partkey, count(*) AS columns, max(n) AS rows, min(n) = max(n) AS valid FROM n GROUP BY p_partkey")
def document_validate(spark, sf):
    return X.validate(_ops(spark, sf), ["p_partkey"])


@query("expand_document", f"WITH {_VALUES} SELECT p_partkey, rid, max(CASE WHEN col_idx = 0 THEN v END) AS a, max(CASE WHEN col_idx = 1 THEN v END) AS b FROM w WHERE p_partkey % 5 <> 0 GROUP BY p_partkey, rid")
def expand_document(spark, sf):
    """The tables of the documents whose columns are of the same length."""
    ops = _ops(spark, sf)
    valid = X.validate(ops, ["p_partkey"]).where("valid").select("p_partkey")
    return X.pivot(X.expand(ops.join(valid, "p_partkey", "left_semi"), ["p_partkey"], "dictionary"), ["a", "b"], ["p_partkey"])


@query(
    "document_info",
    f"""WITH {_VALUES}, g AS (SELECT DISTINCT p_partkey, col_idx, op_idx, CASE WHEN col_idx = 1 OR op_idx = 0 THEN 'range' WHEN op_idx = 1 THEN 'toggle' WHEN op_idx = 2 THEN 'dict' ELSE 'raw' END AS kind, count(*) OVER (PARTITION BY p_partkey, col_idx, op_idx) AS n FROM x),
    h AS (SELECT g.*, CASE WHEN col_idx = 0 AND op_idx = 0 THEN n // base WHEN kind = 'raw' THEN n ELSE 1 END AS times FROM g JOIN b USING (p_partkey))
    SELECT p_partkey, count_if(kind = 'range') AS ranges, count_if(times > 1) AS multipliers, count_if(kind = 'toggle') AS toggles, count_if(kind = 'dict') AS dict_refs, count_if(kind = 'raw') AS raw_values FROM h GROUP BY p_partkey""",
)
def document_info(spark, sf):
    """Operators by kind; the SQL counts them in the expanded values."""
    return X.info(_ops(spark, sf), ["p_partkey"])


# ------------------------------------------------ documents
def _orders(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", F.col("o_orderdate").cast("string").alias("o_orderdate"), "o_orderpriority")


_ORDERS = I.documents_sql(
    "orders",
    [("o_orderkey", "integer", "CAST(o_orderkey AS VARCHAR)"), ("o_custkey", "integer", "CAST(o_custkey AS VARCHAR)"), ("o_orderstatus", "string", "o_orderstatus"), ("o_totalprice", "float", I.number_sql("o_totalprice")),
     ("o_orderdate", "string", "strftime(o_orderdate, '%Y-%m-%d %H:%M:%S')"), ("o_orderpriority", "string", "o_orderpriority")],
    "o_orderkey // 1000", "o_orderkey % 1000",
)


@query("compress_table", f"WITH {_ORDERS} SELECT chunk, format, document, original_size, encoded_size, ratio FROM docs")
def compress_table(spark, sf):
    """Documents of 1000 orders each."""
    return codec.compress(_orders(spark, sf), dense="o_orderkey", chunk_rows=1000)


@query("serialize_document")
def serialize_document(spark, sf):
    """The derived pattern columns of events as documents of 10,000 rows."""
    t = table(spark, sf, "events").select("event_id", *[F.expr(e.format(str="STRING")).alias(n) for n, e in I.COLUMNS.items()])
    return codec.compress(t, dense="event_id", chunk_rows=10_000)


@query("parse_document")
def parse_document(spark, sf):
    """The operators of those documents, read back from their text."""
    return Doc.parse_documents(serialize_document(spark, sf)).select("chunk", "doc_format", "col_idx", "op_idx", "kind", "repeats", "text", "start", "end", "step", F.array_join("values", "~").alias("cycle"), "count", "dict_idx")


_V1 = "(SELECT format FROM docs WHERE docs.chunk = y.chunk) = 'v1'"
_TOKENS = f"""{_ORDERS}, tc AS (SELECT y.*, {_V1} AS v1, {_V1} AND op IS NOT NULL AS is_op, contains(op, ':') AS stepped FROM y),
    ts AS (SELECT chunk, any_value(v1) AS v1, count(*) AS columns, count_if(is_op) AS ops, count_if(is_op AND stepped) AS steps, sum(CASE WHEN is_op THEN 0 WHEN v1 THEN own_ints ELSE ints END) AS ints,
        sum(CASE WHEN is_op THEN 0 WHEN v1 THEN own_floats ELSE floats END) AS floats, sum(CASE WHEN is_op OR NOT v1 THEN 0 ELSE refs END) AS refs, sum(CASE WHEN is_op THEN 0 ELSE n END) AS literals FROM tc GROUP BY chunk),
    tt AS (SELECT *, v1 AND chunk IN (SELECT chunk FROM dl) AS dict FROM ts),
    tu AS (SELECT chunk, unnest([{{'token': 'version', 'n': 1}}, {{'token': 'dict_line', 'n': dict::INT}}, {{'token': 'newline', 'n': 2 + dict::INT}}, {{'token': 'name', 'n': columns}}, {{'token': '|', 'n': columns - 1}}, {{'token': '>', 'n': ops}}, {{'token': ':', 'n': steps}},
        {{'token': 'int', 'n': ints + 2 * ops + steps}}, {{'token': 'float', 'n': floats}}, {{'token': 'ref', 'n': refs}}, {{'token': 'raw', 'n': literals - refs - ints - floats}}, {{'token': 'end', 'n': 1}}], recursive := true) FROM tt)"""


@query("tokenize", f"WITH {_TOKENS} SELECT chunk, token, n::BIGINT AS n FROM tu WHERE n > 0")
def tokenize(spark, sf):
    """How many tokens of each kind stand in the documents of orders."""

    def run(batches):
        from collections import Counter

        import pandas as pd

        for pdf in batches:
            rows = [(c, k, n) for c, d in zip(pdf["chunk"], pdf["document"], strict=True) for k, n in Counter(t[0] for t in Doc.Scanner(d).tokens()).items()]
            yield pd.DataFrame(rows, columns=["chunk", "token", "n"])

    return compress_table(spark, sf).select("chunk", "document").mapInPandas(run, "chunk long, token string, n long")


@query("roundtrip_table", "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS o_orderdate, o_orderpriority FROM orders")
def roundtrip_table(spark, sf):
    """Orders written as documents, parsed, expanded and typed again: the same table."""
    return codec.decompress(compress_table(spark, sf), schema=_orders(spark, sf).schema).drop("chunk", "rid")


@query(
    "document_report",
    f"""WITH {_ORDERS}, rc AS (SELECT y.*, {_V1} AND op IS NOT NULL AS is_op, {_V1} AS v1 FROM y)
    SELECT chunk, count(*) AS columns, max(n) AS rows, min(n) = max(n) AS valid, count_if(is_op AND contains(op, '>')) AS ranges, count_if(is_op AND NOT contains(op, '>')) AS multipliers, 0::BIGINT AS toggles, sum(CASE WHEN is_op OR NOT v1 THEN 0 ELSE refs END)::BIGINT AS dict_refs,
    sum(CASE WHEN is_op THEN CASE WHEN contains(op, '>') THEN 0 ELSE 1 END WHEN v1 THEN n - refs ELSE n END)::BIGINT AS raw_values, (SELECT strlen(document) FROM docs WHERE docs.chunk = rc.chunk)::INTEGER AS document_bytes,
    (max(n) * count(*) * 11 + sum(strlen(col_name) + 1))::BIGINT AS estimated_bytes FROM rc GROUP BY chunk""",
)
def document_report(spark, sf):
    """Shape, operators and sizes of the documents of orders."""
    return codec.info(compress_table(spark, sf))


_EVENTS = I.documents_sql(
    "(SELECT *, row_number() OVER (ORDER BY event_id) - 1 AS nth FROM events)",
    [("event_id", "integer", "CAST(event_id AS VARCHAR)"), ("ts", "string", "CAST(ts AS VARCHAR)"), ("user_id", "integer", "CAST(user_id AS VARCHAR)"), ("event_type", "string", "event_type"), ("value", "float", I.number_sql("value")), ("props", "string", "props")],
    "nth // 1000", "nth % 1000",
)


# ------------------------------------------------ reports, files and streams
@query(
    "compress_report",
    f"""WITH {_ORDERS} SELECT chunk, col_name, CASE WHEN op IS NULL THEN 'raw' WHEN NOT contains(op, '>') THEN 'repeat' WHEN contains(op, ':') THEN 'arithmetic' ELSE 'sequential' END AS pattern, n AS value_count, input_bytes, strlen(coalesce(op, raw))::BIGINT AS output_bytes,
    input_bytes - strlen(coalesce(op, raw)) AS bytes_saved, strlen(coalesce(op, raw)) < input_bytes AS was_compressed, CASE WHEN op IS NULL THEN refs ELSE 0 END AS dict_refs, CASE WHEN op IS NULL THEN n - refs ELSE 0 END AS raws FROM y""",
)
def compress_report(spark, sf):
    """What became of each column of each document of orders."""
    stats = codec.compress_with_stats(codec.chunked_cells(_orders(spark, sf), dense="o_orderkey", chunk_rows=1000))[1]
    return stats.select("chunk", "col_name", "pattern", "value_count", "input_bytes", "output_bytes", "bytes_saved", "was_compressed", "dict_refs", "raws")


@query(
    "dictionary_utilization",
    f"""WITH {_ORDERS}, du AS (SELECT chunk, count(DISTINCT idx) AS used FROM dg JOIN y USING (chunk, col_idx) WHERE op IS NULL GROUP BY chunk), dn AS (SELECT chunk, count(*) AS entries FROM dd GROUP BY chunk)
    SELECT chunk, coalesce(entries, 0) AS dictionary_entries, CASE WHEN used > 0 THEN 1.0::DOUBLE ELSE 0 END AS dictionary_utilization, CASE WHEN entries > 0 THEN used / entries::DOUBLE ELSE 0.0 END AS dictionary_utilization_actual FROM du LEFT JOIN dn USING (chunk)""",
)
def dictionary_utilization(spark, sf):
    return codec.compress_with_stats(codec.chunked_cells(_orders(spark, sf), dense="o_orderkey", chunk_rows=1000))[2]


@query("csv_oneshot", "SELECT c_custkey, c_name, c_acctbal, c_mktsegment FROM customer")
def csv_oneshot(spark, sf):
    """Customers to CSV files, these to documents, and a typed table from them."""
    at = fresh_path(spark, "csv")
    T.write_csv(table(spark, sf, "customer").select(F.col("c_custkey").alias("rid"), "c_custkey", "c_name", "c_acctbal", "c_mktsegment"), at)
    return codec.decompress(codec.compress_csv(spark, at)).select(F.col("c_custkey").cast("long"), "c_name", F.col("c_acctbal").cast("double"), "c_mktsegment")


@query("json_oneshot", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
def json_oneshot(spark, sf):
    """Nations as one JSON array, that as a document, and a table from it."""
    at, t = fresh_path(spark, "json"), table(spark, sf, "nation").select("n_nationkey", "n_name", "n_regionkey")
    spark.createDataFrame([(T.json_array(t.withColumn("rid", F.col("n_nationkey"))),)], "value string").write.text(at)  # 25 rows at any scale
    return codec.decompress(codec.compress_json(spark, at)).select(F.col("n_nationkey").cast("int"), "n_name", F.col("n_regionkey").cast("int"))


@query("row_stream", "SELECT CAST(s_suppkey AS VARCHAR) AS s_suppkey, s_name FROM supplier")
def row_stream(spark, sf):
    """Suppliers as documents in files, read back row by row as a stream."""
    at, out = fresh_path(spark, "documents"), fresh_path(spark, "rows")
    docs = codec.compress(table(spark, sf, "supplier").select("s_suppkey", "s_name"), order_by=["s_suppkey"])
    docs.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "chunk").select("chunk", "document").write.partitionBy("chunk").text(at)
    rows = chunks.read_rows(spark, at)
    rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", fresh_path(spark, "stream")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out)


@query("chunk_documents", f"WITH {_EVENTS} SELECT chunk, format, document, original_size, encoded_size, ratio FROM docs")
def chunk_documents(spark, sf):
    """Events in their order in time, 1000 to a document."""
    return chunks.chunk_documents(table(spark, sf, "events"), ["event_id"], chunk_rows=1000)


@query("pandas_roundtrip", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
def pandas_roundtrip(spark, sf):
    """A pandas table in, a document in between, a table out."""
    pdf = table(spark, sf, "nation").orderBy("n_nationkey").toPandas()  # 25 rows at any scale
    docs = codec.compress(T.from_pandas(spark, pdf), dense="rid", chunk_rows=None, drop_index=True)
    back = codec.decompress(docs)
    return back.select(F.col("n_nationkey").cast("int"), "n_name", F.col("n_regionkey").cast("int"))


@query("array_roundtrip", "SELECT n_nationkey::BIGINT AS key, n_regionkey::BIGINT AS col1 FROM nation")
def array_roundtrip(spark, sf):
    """A numpy array in, a document in between, a table out."""
    a = table(spark, sf, "nation").orderBy("n_nationkey").select("n_nationkey", "n_regionkey").toPandas().to_numpy()  # 25 rows at any scale
    docs = codec.compress(T.from_array(spark, a, ["key", "col1"]), dense="rid", chunk_rows=None, drop_index=True)
    return codec.decompress(docs).select(F.col("key").cast("long"), F.col("col1").cast("long"))


# ------------------------------------------------ log lines in SQL
_HEAD = r"'^\s*(\S+)\s+(\S+)\s+(\S+)\s+(\S+)\s+(\S.*?)\s*$'"


def _g(k: int) -> str:
    return f"nullif(regexp_extract(line, {_HEAD}, {k}), '')"


_F = rf"""{I.LINES_SQL}, f0 AS (SELECT rid, line, {_g(1)} AS mon_, {_g(2)} AS d, {_g(3)} AS time_, {_g(4)} AS host_, {_g(5)} AS rest_ FROM l),
f1 AS (SELECT *, CASE WHEN regexp_full_match(d, '[0-9]+') THEN try_cast(d AS INTEGER) END AS day_ FROM f0),
f AS (SELECT rid, line, CASE WHEN day_ BETWEEN 0 AND 255 THEN mon_ END AS month, CASE WHEN day_ BETWEEN 0 AND 255 THEN day_ END AS day, CASE WHEN day_ BETWEEN 0 AND 255 THEN time_ END AS time, CASE WHEN day_ BETWEEN 0 AND 255 THEN host_ END AS hostname, CASE WHEN day_ BETWEEN 0 AND 255 THEN rest_ END AS rest FROM f1),
g0 AS (SELECT *, CASE WHEN contains(rest, ':') THEN split_part(rest, ':', 1) END AS head FROM f),
g1 AS (SELECT *, regexp_matches(head, '^[^\[]*\[.*\]') AS br FROM g0),
g AS (SELECT *, CASE WHEN br THEN split_part(head, '[', 1) ELSE head END AS service, CASE WHEN br AND regexp_full_match(regexp_extract(head, '^[^\[]*\[([^\]]*)\]', 1), '[0-9]+') THEN try_cast(regexp_extract(head, '^[^\[]*\[([^\]]*)\]', 1) AS BIGINT) END AS pid,
CASE WHEN head IS NOT NULL THEN ltrim(rest[length(head) + 2:]) END AS message FROM g1)"""
_CLASS = """CASE WHEN message LIKE 'authentication failure%' THEN 'auth_fail' WHEN message LIKE 'check pass%' THEN 'check_pass' WHEN message LIKE 'session opened%' THEN 'sess_open' WHEN message LIKE 'session closed%' THEN 'sess_close'
WHEN message LIKE 'connection from%' THEN 'ftp_conn' WHEN contains(message, 'timed out') THEN 'ftp_timeout' WHEN contains(message, 'startup succeeded') OR contains(message, 'shutdown succeeded') THEN 'svc_status' WHEN message LIKE 'ALERT exited abnormally%' THEN 'logrotate'
WHEN contains(message, 'restart') THEN 'syslog_restart' WHEN message LIKE 'Received SNMP%' THEN 'snmp' WHEN contains(message, 'Kerberos') OR contains(message, 'Authentication failed from') THEN 'kerberos' WHEN message IS NOT NULL THEN 'other' END"""


def _par(key: str) -> str:
    return rf"CASE WHEN message LIKE 'authentication failure%' THEN CASE WHEN regexp_matches(message, '(^|\s){key}=') THEN nullif(regexp_extract(message, '(?:^|\s){key}=(\S*)', 1), '') ELSE nullif(regexp_extract(message, '{key}=(\S*)', 1), '') END END"


_SESSION = "CASE WHEN contains(message, 'for user ') THEN regexp_extract(message, 'for user ([^ ]*)', 1) END"
_PEER = "CASE WHEN contains(message, 'connection from ') THEN regexp_extract(message, 'connection from ([^ (]*)', 1) END"
_PARSED = f"{_F}, h AS (SELECT *, {_CLASS} AS cls, {_par('rhost')} AS rhost_, {_par('user')} AS user_ FROM g)"
_ROW = """rid, CASE WHEN message IS NOT NULL THEN month END AS month, CASE WHEN message IS NOT NULL THEN day END AS day, CASE WHEN message IS NOT NULL THEN time END AS time, CASE WHEN message IS NOT NULL THEN hostname END AS hostname, service, pid,
coalesce(cls, 'parse_error') AS msg_type, rhost_ AS rhost, coalesce(user_, CASE WHEN cls IN ('sess_open', 'sess_close') THEN """ + _SESSION + """ END) AS "user", coalesce(message, trim(line)) AS message"""


@query("syslog_fields", f"WITH {_F} SELECT rid, month, day, time, hostname, rest FROM f")
def syslog_fields(spark, sf):
    t = I.lines(spark, sf).select("rid", L.words(F.col("line")).alias("w"))
    return t.select("rid", *[v.alias(k) for k, v in L.fields_of(F.col("w")).items()])


@query("syslog_service", f"WITH {_F} SELECT rid, service, pid, message FROM g")
def syslog_service(spark, sf):
    return L.split_lines(I.lines(spark, sf), "line").select("rid", *[F.col(f"_{k}").alias(k) for k in ("service", "pid", "message")])


def _messages(spark, sf):
    return L.split_lines(I.lines(spark, sf), "line").select("rid", F.col("_message").alias("m"))


@query("syslog_classify", f"WITH {_F} SELECT rid, {_CLASS} AS msg_type FROM g")
def syslog_classify(spark, sf):
    return _messages(spark, sf).select("rid", L.classify(F.col("m")).alias("msg_type"))


@query("syslog_params", f"WITH {_F} SELECT rid, " + ", ".join(f'{_par(k)} AS "{k}"' for k in ("rhost", "user", "uid", "euid", "tty", "ruser")) + " FROM g")
def syslog_params(spark, sf):
    return _messages(spark, sf).select("rid", *[v.alias(k) for k, v in L.parameters(F.col("m")).items()])


@query(
    "syslog_extract",
    f"""WITH {_F}, h AS (SELECT *, {_CLASS} AS cls FROM g) SELECT rid, CASE WHEN cls IN ('sess_open', 'sess_close') THEN {_SESSION} END AS session_user,
    CASE WHEN cls = 'ftp_conn' THEN {_PEER} WHEN cls = 'snmp' AND contains(message, 'from ') THEN regexp_extract(message, 'from ([^ ]*)', 1) WHEN cls = 'kerberos' AND contains(message, 'from ') THEN regexp_extract(message, 'from ([^ (]*)', 1) END AS ip,
    CASE WHEN cls = 'ftp_conn' THEN nullif(regexp_extract(message, 'connection from [^(]*\\(([^)]*)\\)', 1), '') END AS resolved_host,
    CASE WHEN cls = 'logrotate' THEN try_cast(regexp_extract(message, '\\[([+-]?[0-9]+)\\]', 1) AS INTEGER) END AS exit_code, CASE WHEN cls = 'svc_status' THEN CASE WHEN contains(message, 'startup') THEN 'startup' ELSE 'shutdown' END END AS status FROM h""",
)
def syslog_extract(spark, sf):
    return _messages(spark, sf).select("rid", *[v.alias(k) for k, v in L.extracts(F.col("m")).items()])


@query("syslog_parse", f"WITH {_PARSED} SELECT {_ROW} FROM h")
def syslog_parse(spark, sf):
    return L.parse(I.lines(spark, sf)).drop("line")


@query(
    "syslog_render",
    f"""WITH {_PARSED}, r AS (SELECT {_ROW} FROM h) SELECT rid, coalesce(month, '') || ' ' || lpad(CAST(coalesce(day, 0) AS VARCHAR), 2, ' ') || ' ' || coalesce(time, '') || ' ' || coalesce(hostname, '') || ' ' || coalesce(service, '')
    || CASE WHEN pid IS NOT NULL THEN '[' || CAST(pid AS VARCHAR) || ']' ELSE '' END || ': ' || coalesce(message, '') AS line FROM r""",
)
def syslog_render(spark, sf):
    t = L.parse(I.lines(spark, sf)).drop("line")
    return t.select("rid", L.render({c: F.col(c) for c in ("month", "day", "time", "hostname", "service", "pid", "message")}).alias("line"))


_CODE = """CASE WHEN message LIKE 'authentication failure%' THEN 'A' WHEN message LIKE 'check pass%' THEN 'C' WHEN message LIKE 'session opened%' THEN 'O' WHEN message LIKE 'session closed%' THEN 'X' WHEN message LIKE 'connection from%' THEN 'F'
WHEN contains(message, 'ALERT exited abnormally') THEN 'L' WHEN contains(message, 'shutdown succeeded') THEN 'D' WHEN contains(message, 'startup succeeded') THEN 'U' WHEN contains(message, 'restart') THEN 'R' WHEN message LIKE 'Received SNMP%' THEN 'S'
WHEN contains(message, 'Kerberos') OR contains(message, 'Authentication failed from') THEN 'K' WHEN contains(message, 'timed out') OR contains(message, 'User unknown') THEN 'T' WHEN contains(message, 'cupsd') THEN 'P' ELSE '?' END"""


def _val(key: str) -> str:
    return rf"nullif(regexp_extract(message, '{key}\s*(\S*)', 1), '')"


_TEMPLATE = f"""{_F}, i AS (SELECT *, {_CODE} AS code FROM g),
j AS (SELECT *, CASE WHEN code = 'A' THEN {_val('rhost=')} WHEN code IN ('O', 'X') THEN {_SESSION} WHEN code = 'F' THEN {_PEER} WHEN code = 'S' THEN {_val('from ')} END AS v1, CASE WHEN code = 'A' THEN {_val('user=')} END AS v2 FROM i)"""


@query("syslog_template", f"WITH {_TEMPLATE} SELECT rid, code, v1, v2 FROM j")
def syslog_template(spark, sf):
    return _messages(spark, sf).select("rid", *[v.alias(k) for k, v in L.template(F.col("m")).items()])


_COMPACT = rf"""{_TEMPLATE}, k0 AS (SELECT *, list_position({I.duck_list(L.MONTHS)}, month) - 1 AS mo, CASE WHEN regexp_full_match(time, '[0-9]+:[0-9]+:[0-9]+') THEN string_split(time, ':') END AS tp FROM j),
k1 AS (SELECT *, message IS NOT NULL AND mo >= 0 AND tp IS NOT NULL AS ok FROM k0),
k AS (SELECT rid, CASE WHEN ok THEN mo END AS mo, CASE WHEN ok THEN day END AS day, CASE WHEN ok THEN tp[1]::INT END AS h, CASE WHEN ok THEN tp[2]::INT END AS mi, CASE WHEN ok THEN tp[3]::INT END AS sec, CASE WHEN ok THEN service END AS service, CASE WHEN ok THEN pid END AS pid, CASE WHEN ok THEN code ELSE '?' END AS code, CASE WHEN ok THEN v1 END AS v1, CASE WHEN ok THEN v2 END AS v2 FROM k1),
si AS (SELECT service, row_number() OVER (ORDER BY min(rid)) - 1 AS id FROM k WHERE service IS NOT NULL GROUP BY service), vi AS (SELECT v1, row_number() OVER (ORDER BY min(rid)) - 1 AS id FROM k WHERE v1 IS NOT NULL GROUP BY v1), ui AS (SELECT v2, row_number() OVER (ORDER BY min(rid)) - 1 AS id FROM k WHERE v2 IS NOT NULL GROUP BY v2)"""


@query("syslog_parse_optimized", f"WITH {_COMPACT} SELECT rid, mo AS mon, day, h AS hour, mi AS minute, sec AS second, si.id AS svc, pid, code, vi.id AS var1, ui.id AS var2 FROM k LEFT JOIN si USING (service) LEFT JOIN vi USING (v1) LEFT JOIN ui USING (v2)")
def syslog_parse_optimized(spark, sf):
    return L.compact_ids(I.lines(spark, sf))


@query("intern_ids", "SELECT user_id AS value, row_number() OVER (ORDER BY min(event_id)) - 1 AS id FROM events GROUP BY user_id")
def intern_ids(spark, sf):
    return L.intern(table(spark, sf, "events").select(F.col("event_id").alias("rid"), "user_id"), "user_id")


_CODEC = f"""{_COMPACT}, cx AS (SELECT rid // 10000 AS chunk, row_number() OVER (PARTITION BY rid // 10000 ORDER BY rid) - 1 AS nth, *, CASE WHEN code IN ('A', 'F', 'S') THEN v1 END AS ip, CASE WHEN code = 'A' THEN v2 WHEN code IN ('O', 'X') THEN v1 END AS usr FROM k WHERE mo IS NOT NULL),
    cv AS (SELECT chunk, nth, 'S' AS tag, service AS val FROM cx UNION ALL SELECT chunk, nth, 'I', ip FROM cx UNION ALL SELECT chunk, nth, 'U', usr FROM cx),
    ci AS (SELECT chunk, tag, val, row_number() OVER (PARTITION BY chunk, tag ORDER BY min(nth), val) - 1 AS id FROM cv WHERE val IS NOT NULL GROUP BY chunk, tag, val), ct AS (SELECT chunk, tag, string_agg(val, '|' ORDER BY id) AS words FROM ci GROUP BY chunk, tag),
    cd AS (SELECT cv.chunk, nth, cv.tag, CASE WHEN id IS NULL THEN '-1' ELSE CAST(id AS VARCHAR) END AS v FROM cv LEFT JOIN ci ON cv.chunk = ci.chunk AND cv.tag = ci.tag AND cv.val = ci.val),
    cc AS ({" UNION ALL ".join(f"SELECT chunk, nth, {k} AS k, '{n}' AS name, CAST({c} AS VARCHAR) AS v FROM cx" for k, n, c in ((0, "m", "mo"), (1, "d", "day"), (2, "H", "h"), (3, "M", "mi"), (4, "S", "sec"), (6, "p", "pid"), (7, "t", "CASE WHEN code = 'P' THEN '?' ELSE code END")))}
        UNION ALL SELECT chunk, nth, CASE tag WHEN 'S' THEN 5 WHEN 'I' THEN 8 ELSE 9 END, CASE tag WHEN 'S' THEN 's' WHEN 'I' THEN 'i' ELSE 'u' END, v FROM cd),
    cr AS (SELECT *, CASE WHEN v IS NOT DISTINCT FROM lag(v) OVER w AND nth > 0 THEN 0 ELSE 1 END AS new FROM cc WINDOW w AS (PARTITION BY chunk, k ORDER BY nth)), cg AS (SELECT *, sum(new) OVER (PARTITION BY chunk, k ORDER BY nth) AS run FROM cr),
    cn AS (SELECT chunk, k, name, run, coalesce(min(v), '-') AS v, count(*) AS n, min(nth) AS nth FROM cg GROUP BY chunk, k, name, run),
    cl AS (SELECT chunk, k, '@' || name || ':' || string_agg(CASE WHEN n > 2 THEN v || '*' || n || ' ' ELSE repeat(v || ' ', n) END, '' ORDER BY nth) || chr(10) AS line FROM cn GROUP BY chunk, k, name)"""


@query(
    "syslog_codec",
    f"""WITH {_CODEC} SELECT chunk, '!L1' || chr(10) || {" || ".join(f"'${t}:' || coalesce((SELECT words FROM ct WHERE ct.chunk = cl.chunk AND tag = '{t}'), '') || chr(10)" for t in "SIU")} || string_agg(line, '' ORDER BY k) AS document FROM cl GROUP BY chunk""",
)
def syslog_codec(spark, sf):
    """Run-length coded documents of 10,000 lines."""
    lines = I.lines(spark, sf).withColumns({"chunk": F.floor(F.col("rid") / 10_000), "rid": F.col("rid") % 10_000})
    return L.codec(lines)
