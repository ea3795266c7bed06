"""Pattern detection, runs, dictionary, encoding choice and statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from colpattern.catalog import inputs as I
from colpattern.catalog.registry import query, table
from colpattern.operators import dictionary as D
from colpattern.operators import encode as E
from colpattern.operators import runs as R
from colpattern.operators.detect import detect
from colpattern.storage import cut

# ------------------------------------------------ the detectors in SQL
_INT = "regexp_matches(trim(v), '^[+-]?[0-9]+$') AND try_cast(trim(v) AS BIGINT) IS NOT NULL"
_SIGN = "length(CAST({x} AS VARCHAR))"


def _span(a: str, b: str, s: str) -> str:
    return f"(length(CAST({a} AS VARCHAR)) + 1 + length(CAST({b} AS VARCHAR)) + CASE WHEN abs({s}) = 1 THEN 0 ELSE 1 + length(CAST({s} AS VARCHAR)) END)"


_PROFILE = f"""{I.CELLS_SQL},
p AS (SELECT col_name, count(*) AS n, sum(strlen(v))::BIGINT AS bytes, min(v) AS mn, max(v) AS mx, bool_and({_INT}) AS ints, {", ".join(f"max(CASE WHEN rid = {i} THEN v END) AS h{i}" for i in range(8))} FROM c GROUP BY col_name),
q AS (SELECT *, [h0, h1, h2, h3, h4, h5, h6, h7] AS head, CASE WHEN ints THEN try_cast(trim(h0) AS BIGINT) END AS v0, CASE WHEN ints THEN try_cast(trim(h1) AS BIGINT) - try_cast(trim(h0) AS BIGINT) END AS step FROM p),
rb AS (SELECT c.col_name, min(CASE WHEN coalesce(try_cast(trim(v) AS BIGINT) = v0 + rid * step, false) THEN NULL ELSE rid END) AS b, {", ".join(f"min(CASE WHEN v <> head[(rid % {k} + 1)::INT] THEN rid END) AS b{k}" for k in range(2, 9))} FROM c JOIN q USING (col_name) GROUP BY c.col_name),
s AS (SELECT q.*, rb.* EXCLUDE (col_name), bytes + n - 1 AS size FROM q JOIN rb USING (col_name))"""

_RANGE = f"""dr AS (SELECT col_name, CASE WHEN abs(step) = 1 THEN 'sequential' ELSE 'arithmetic' END AS pattern, size / {_span("v0", "(v0 + (n - 1) * step)", "step")}::DOUBLE AS ratio, v0 AS "start", v0 + (n - 1) * step AS "end", step, n AS period
FROM s WHERE ints AND step <> 0 AND b IS NULL AND n >= 3)"""
_REPEAT = """dp AS (SELECT col_name, 'repeat' AS pattern, size / (strlen(mn) + 1 + length(CAST(n AS VARCHAR)))::DOUBLE AS ratio, NULL::BIGINT AS "start", NULL::BIGINT AS "end", NULL::BIGINT AS step, n AS period FROM s WHERE mn = mx AND n >= 3)"""
_KS = "k AS (SELECT unnest(range(2, 9)) AS k)"
_CYC = "(SELECT sum(strlen(x)) FROM (SELECT unnest(head[1:k]) AS x))"
_BK = "CASE k " + " ".join(f"WHEN {k} THEN b{k}" for k in range(2, 9)) + " END"
_TOGGLE = f"""t0 AS (SELECT s.*, k, list_sum(list_transform(head[1:k], lambda x: strlen(x))) AS cyc, {_BK} AS bk FROM s, k WHERE n >= k AND len(list_distinct(head[1:k])) >= 2),
dt AS (SELECT col_name, 'toggle' AS pattern, size / (cyc + k - 1 + 1 + length(CAST(n AS VARCHAR)))::DOUBLE AS ratio, NULL::BIGINT AS "start", NULL::BIGINT AS "end", NULL::BIGINT AS step, n AS period, k FROM t0 WHERE bk IS NULL AND n >= 3
QUALIFY row_number() OVER (PARTITION BY col_name ORDER BY k) = 1)"""
_REPRANGE = f"""rr AS (SELECT s.* FROM s WHERE ints AND step <> 0 AND n >= 4 AND b >= 2 AND b <= 100000 AND n % nullif(b, 0) = 0 AND n / nullif(b, 0) >= 2),
rv AS (SELECT rr.col_name FROM c JOIN rr USING (col_name) GROUP BY rr.col_name HAVING bool_and(v = CAST(v0 + (rid % nullif(b, 0)) * step AS VARCHAR))),
dd AS (SELECT col_name, 'repeated_range' AS pattern, size / ({_span("v0", "(v0 + (b - 1) * step)", "step")} + 3 + length(CAST(n // nullif(b, 0) AS VARCHAR)))::DOUBLE AS ratio, v0 AS "start", v0 + (b - 1) * step AS "end", step, b AS period
FROM rr WHERE col_name IN (SELECT col_name FROM rv) AND (bytes / (n / nullif(b, 0)) + b - 1) / {_span("v0", "(v0 + (b - 1) * step)", "step")} > 1)"""
#: Every period up to 64 that divides the length, tried with every cycle (longer ones than the shortest that holds never win).
_REPTOGGLE = """pp AS (SELECT unnest(range(2, 65)) AS p),
rt0 AS (SELECT t0.col_name, n, size, head, k, p, cyc, list_sum(list_transform(range(p), lambda i: strlen(head[(i % k + 1)::INT]))) + p - 1 AS chunk FROM t0, pp WHERE n % p = 0 AND p <= n / 2 AND k <= p AND n >= 4),
rt1 AS (SELECT * FROM rt0 WHERE chunk / (cyc + k - 1 + 1 + length(CAST(p AS VARCHAR)))::DOUBLE > 1),
rt2 AS (SELECT rt1.col_name, p, k FROM c JOIN rt1 USING (col_name) GROUP BY rt1.col_name, p, k HAVING bool_and(v = head[(rid % p % k + 1)::INT])),
dg AS (SELECT col_name, 'repeated_toggle' AS pattern, (SELECT size FROM s WHERE s.col_name = rt2.col_name) / (11 + log10((SELECT n FROM s WHERE s.col_name = rt2.col_name) / p::DOUBLE)) AS ratio, NULL::BIGINT AS "start", NULL::BIGINT AS "end", NULL::BIGINT AS step, p AS period, k
FROM rt2 QUALIFY row_number() OVER (PARTITION BY col_name ORDER BY p, k) = 1)"""
_BEST = """o AS (SELECT 1 AS ord, *, NULL::BIGINT AS k FROM dr UNION ALL SELECT 2, *, 1 FROM dp UNION ALL SELECT 3, * FROM dt UNION ALL SELECT 4, *, NULL FROM dd UNION ALL SELECT 5, * FROM dg),
best AS (SELECT s.col_name, s.n, s.head, coalesce(o.pattern, 'raw') AS pattern, coalesce(o.ratio, 1.0) AS ratio, o."start", o."end", o.step, o.period, CASE WHEN o.pattern IS NOT NULL THEN s.n // o.period END AS repeats, o.k
FROM s LEFT JOIN (SELECT * FROM o WHERE ratio > 1 QUALIFY row_number() OVER (PARTITION BY col_name ORDER BY ratio DESC, ord) = 1) o USING (col_name))"""
_ALL = f"WITH {_PROFILE}, {_RANGE}, {_REPEAT}, {_KS}, {_TOGGLE}, {_REPRANGE}, {_REPTOGGLE}, {_BEST}"


def _found(spark, sf, *names: str):
    t = detect(I.cells(spark, sf))
    return t.where(F.col("pattern").isin(*names))


def _out() -> list:
    return ["col_name", "pattern", F.round("ratio", 6).alias("ratio"), "start", "end", "step", "period"]


_OUT_SQL = 'col_name, pattern, round(ratio, 6) AS ratio, "start", "end", step, period'


@query("detect_range", f"WITH {_PROFILE}, {_RANGE} SELECT {_OUT_SQL} FROM dr WHERE ratio > 1")
def detect_range(spark, sf):
    return _found(spark, sf, "sequential", "arithmetic").select(*_out())


@query("detect_repeat", f"WITH {_PROFILE}, {_REPEAT} SELECT {_OUT_SQL} FROM dp WHERE ratio > 1")
def detect_repeat(spark, sf):
    return _found(spark, sf, "repeat").select(*_out())


@query("detect_toggle", f"WITH {_PROFILE}, {_KS}, {_TOGGLE} SELECT dt.col_name, pattern, round(ratio, 6) AS ratio, array_to_string(head[1:dt.k], '~') AS cycle FROM dt JOIN s USING (col_name) WHERE ratio > 1")
def detect_toggle(spark, sf):
    """The columns that are a plain cycle, whether or not repetition would say it shorter."""
    t = detect(I.cells(spark, sf), only=("toggle",)).where("pattern = 'toggle'")
    return t.select("col_name", "pattern", F.round("ratio", 6).alias("ratio"), F.array_join("cycle", "~").alias("cycle"))


@query("detect_repeated_range", f"{_ALL} SELECT {_OUT_SQL}, repeats FROM best WHERE pattern = 'repeated_range'")
def detect_repeated_range(spark, sf):
    return _found(spark, sf, "repeated_range").select(*_out(), "repeats")


@query("detect_repeated_toggle", f"{_ALL} SELECT {_OUT_SQL}, repeats FROM best WHERE pattern = 'repeated_toggle'")
def detect_repeated_toggle(spark, sf):
    return _found(spark, sf, "repeated_toggle").select(*_out(), "repeats")


@query("detect_best", f"{_ALL} SELECT {_OUT_SQL}, repeats, n FROM best")
def detect_best(spark, sf):
    return detect(I.cells(spark, sf)).select(*_out(), "repeats", "n")


_UNIT = """CAST("start" AS VARCHAR) || '>' || CAST("end" AS VARCHAR) || CASE WHEN step = CASE WHEN "end" >= "start" THEN 1 ELSE -1 END THEN '' ELSE ':' || CAST(step AS VARCHAR) END"""
_CYCLE = "array_to_string(head[1:k], '~') || '*' || CAST(period AS VARCHAR)"
_OPERATOR = f"""CASE pattern WHEN 'sequential' THEN {_UNIT} WHEN 'arithmetic' THEN {_UNIT} WHEN 'repeat' THEN head[1] || '*' || CAST(n AS VARCHAR) WHEN 'toggle' THEN {_CYCLE}
    WHEN 'repeated_range' THEN '(' || {_UNIT} || ')*' || CAST(repeats AS VARCHAR) WHEN 'repeated_toggle' THEN '(' || {_CYCLE} || ')*' || CAST(repeats AS VARCHAR) END"""


@query("column_encoding_choice", f"{_ALL} SELECT col_name, pattern, {_OPERATOR} AS operator FROM best")
def column_encoding_choice(spark, sf):
    c = I.cells(spark, sf)
    names = c.select("col_idx", "col_name").distinct()
    return E.choose(c).join(F.broadcast(names), "col_idx").select("col_name", "pattern", "operator")


# ------------------------------------------------ runs
def _column(spark, sf, name: str):
    return table(spark, sf, "events").select(F.col("event_id").alias("rid"), F.col(name).alias("v"))


_RUNS = """WITH e AS (SELECT event_id, {v} AS v, CASE WHEN {v} = lag({v}) OVER (ORDER BY event_id) THEN 0 ELSE 1 END AS b FROM events),
    g AS (SELECT event_id, v, sum(b) OVER (ORDER BY event_id) AS g FROM e), r AS (SELECT min(event_id) AS run_start, min(v) AS run_value, count(*) AS run_count FROM g GROUP BY g)"""


@query("find_runs", _RUNS.format(v="event_type") + " SELECT * FROM r WHERE run_count >= 3")
def find_runs(spark, sf):
    return R.find_runs(_column(spark, sf, "event_type"), 3)


@query("longest_run", _RUNS.format(v="event_type") + " SELECT * FROM r ORDER BY run_count DESC, run_start DESC LIMIT 1")
def longest_run(spark, sf):
    return R.longest_run(_column(spark, sf, "event_type"))


@query("string_runs", _RUNS.format(v="event_type") + " SELECT run_start, run_count FROM r")
def string_runs(spark, sf):
    return R.find_runs(_column(spark, sf, "event_type")).select("run_start", "run_count")


@query("int_runs", _RUNS.format(v="(user_id // 50)") + " SELECT run_start, run_value, run_count FROM r")
def int_runs(spark, sf):
    return R.find_runs(table(spark, sf, "events").select(F.col("event_id").alias("rid"), F.floor(F.col("user_id") / 50).alias("v")))


@query(
    "arithmetic_segments",
    """WITH d AS (SELECT event_id AS i, user_id - lag(user_id) OVER (ORDER BY event_id) AS st FROM events), m AS (SELECT i, st, CASE WHEN st = lag(st) OVER (ORDER BY i) THEN 0 ELSE 1 END AS b FROM d WHERE st IS NOT NULL),
    g AS (SELECT i, st, sum(b) OVER (ORDER BY i) AS g FROM m) SELECT min(i) - 1 AS seg_start, count(*) + 1 AS seg_len, min(st) AS seg_step FROM g GROUP BY g""",
)
def arithmetic_segments(spark, sf):
    return R.arithmetic_segments(_column(spark, sf, "user_id"))


@query("int_kernels", "SELECT sum(user_id)::BIGINT AS total, min(user_id) AS least, max(user_id) AS most, count(*) FILTER (WHERE user_id = event_id % 100) AS equal FROM events")
def int_kernels(spark, sf):
    e = table(spark, sf, "events")
    return e.agg(F.try_sum("user_id").alias("total"), F.min("user_id").alias("least"), F.max("user_id").alias("most"), F.count_if(F.col("user_id") == F.col("event_id") % 100).alias("equal"))


@query("rle_encode", _RUNS.format(v="event_type") + """ SELECT string_agg(CASE WHEN run_count > 2 THEN run_value || '*' || CAST(run_count AS VARCHAR) || ' ' ELSE repeat(run_value || ' ', run_count::INT) END, '' ORDER BY run_start) AS encoded FROM r""")
def rle_encode(spark, sf):
    return R.rle_encode(_column(spark, sf, "event_type"))


# ------------------------------------------------ dictionary
def _strings(spark, sf):
    parts = [("events", "event_type"), ("orders", "o_orderpriority"), ("part", "p_type"), ("customer", "c_mktsegment"), ("part", "p_brand")]
    out = None
    for t, c in parts:
        one = table(spark, sf, t).select(F.lit(c).alias("col_name"), F.lit("string").alias("kind"), F.col(c).alias("v"))
        out = one if out is None else out.unionByName(one)
    return out


_V = "v AS (SELECT 'event_type' AS col_name, event_type AS v FROM events UNION ALL SELECT 'o_orderpriority', o_orderpriority FROM orders UNION ALL SELECT 'p_type', p_type FROM part UNION ALL SELECT 'c_mktsegment', c_mktsegment FROM customer UNION ALL SELECT 'p_brand', p_brand FROM part)"
_DICT = f"""{_V}, f AS (SELECT v, count(*) AS n FROM v GROUP BY v HAVING count(*) > 1), r AS (SELECT v, n, row_number() OVER (ORDER BY n DESC, v) - 1 AS i FROM f),
    b AS (SELECT v, n, i, strlen(v) * n - (strlen(v) + 1 + (1 + length(CAST(i AS VARCHAR))) * n) AS s FROM r), d AS (SELECT v, n, s AS bytes_saved, row_number() OVER (ORDER BY s DESC, i) - 1 AS dict_idx FROM b WHERE s > 0)"""


@query("value_frequencies", f"WITH {_V} SELECT v, count(*) AS n FROM v GROUP BY v")
def value_frequencies(spark, sf):
    return D.frequencies(_strings(spark, sf))


@query("dictionary_build", f"WITH {_DICT} SELECT * FROM d")
def dictionary_build(spark, sf):
    return D.build(D.frequencies(_strings(spark, sf)))


@query("dictionary_savings", f"WITH {_DICT} SELECT count(*) AS entries, sum(bytes_saved)::BIGINT AS total_bytes_saved, count(*) > 0 AS has_benefit FROM d")
def dictionary_savings(spark, sf):
    return D.savings(D.build(D.frequencies(_strings(spark, sf))))


@query("dictionary_encode", f"WITH {_DICT}, o AS (SELECT o_orderkey, o_orderpriority AS v FROM orders) SELECT o_orderkey, CASE WHEN dict_idx IS NULL THEN o.v ELSE '_' || CAST(dict_idx AS VARCHAR) END AS token FROM o LEFT JOIN d ON o.v = d.v")
def dictionary_encode(spark, sf):
    entries = D.build(D.frequencies(_strings(spark, sf)))
    o = table(spark, sf, "orders").select("o_orderkey", F.col("o_orderpriority").alias("v"))
    return D.encode(o, entries).select("o_orderkey", F.when(F.col("dict_idx").isNull(), F.col("v")).otherwise(F.concat(F.lit("_"), F.col("dict_idx").cast("string"))).alias("token"))


@query("distinct_values", f"WITH {_V} SELECT col_name, count(DISTINCT v) AS distinct_count FROM v GROUP BY col_name")
def distinct_values(spark, sf):
    return _strings(spark, sf).groupBy("col_name").agg(F.countDistinct("v").alias("distinct_count"))


_SETS = f"WITH {I.CELLS_SQL}, s AS (SELECT col_name, list_sort(list(DISTINCT v)) AS vs FROM c GROUP BY col_name)"


@query("boolean_columns", f"{_SETS} SELECT col_name, CASE WHEN lower(vs[2]) IN ('true','yes','y','t','1') AND lower(vs[1]) IN ('false','no','n','f','0') THEN vs[2] ELSE vs[1] END AS first, CASE WHEN lower(vs[2]) IN ('true','yes','y','t','1') AND lower(vs[1]) IN ('false','no','n','f','0') THEN vs[1] ELSE vs[2] END AS second FROM s WHERE len(vs) = 2")
def boolean_columns(spark, sf):
    return D.boolean_columns(I.cells(spark, sf))


@query("enum_columns", f"{_SETS} SELECT col_name, array_to_string(vs, '|') AS members FROM s WHERE len(vs) BETWEEN 2 AND 16")
def enum_columns(spark, sf):
    return D.enum_columns(I.cells(spark, sf))


@query("all_boolean", f"WITH {I.CELLS_SQL} SELECT col_name, bool_and(lower(v) IN ('true','yes','y','t','1','false','no','n','f','0')) AS is_boolean FROM c GROUP BY col_name")
def all_boolean(spark, sf):
    return D.all_boolean(I.cells(spark, sf))


# ------------------------------------------------ sizes and statistics
@query("ctx_encode", f"WITH {I.CELLS_SQL} SELECT col_name, rid, regexp_replace(v, '([>*~|_#$:\\\\ ])', '\\\\\\1', 'g') AS token FROM c")
def ctx_encode(spark, sf):
    """The plain form: every value a literal."""
    return I.cells(spark, sf).select("col_name", "rid", E.literal(F.col("v")).alias("token"))


@query("size_model", f"WITH {I.CELLS_SQL}, g AS (SELECT col_name, sum(strlen(v) + 1) + strlen(col_name) AS b FROM c GROUP BY col_name) SELECT sum(b)::BIGINT AS original_size FROM g")
def size_model(spark, sf):
    return E.size_model(I.cells(spark, sf))


_ENTRIES = f"""f AS (SELECT v, count(*) AS n FROM c WHERE col_name IN ({", ".join(map(I.quote, I.STRINGS))}) GROUP BY v HAVING count(*) > 1), r AS (SELECT v, n, row_number() OVER (ORDER BY n DESC, v) - 1 AS i FROM f),
    b AS (SELECT v, n, i, strlen(v) * n - (strlen(v) + 1 + (1 + length(CAST(i AS VARCHAR))) * n) AS sv FROM r), d AS (SELECT v, row_number() OVER (ORDER BY sv DESC, i) - 1 AS dict_idx FROM b WHERE sv > 0)"""
_COLSTATS = f"""{_ALL}, {_ENTRIES}, x AS (SELECT col_idx, col_name, sum(strlen(c.v) + 1)::BIGINT + strlen(col_name) AS input_bytes, count(*) AS n, count(dict_idx) AS refs, sum(CASE WHEN dict_idx IS NULL THEN strlen(c.v) ELSE 1 + length(CAST(dict_idx AS VARCHAR)) END)::BIGINT + count(*) - 1 AS raw_bytes
    FROM c LEFT JOIN d ON c.v = d.v GROUP BY col_idx, col_name),
    y AS (SELECT x.*, best.pattern, {_OPERATOR.replace("n AS", "best.n AS").replace("CAST(n ", "CAST(best.n ")} AS operator FROM x JOIN best USING (col_name)),
    z AS (SELECT col_idx, col_name, CASE WHEN operator IS NULL THEN 'raw' ELSE pattern END AS pattern, n AS value_count, input_bytes, coalesce(strlen(operator), raw_bytes) AS output_bytes, CASE WHEN operator IS NULL THEN refs ELSE 0 END AS dict_refs, CASE WHEN operator IS NULL THEN n - refs ELSE 0 END AS raws FROM y)"""


def _stats(spark, sf):
    return _sizes(spark, sf)[0]


def _sizes(spark, sf):
    c = I.cells(spark, sf)
    entries = cut(D.build(D.frequencies(I.cells(spark, sf, I.STRINGS))))
    return E.sizes(c, entries), entries


@query("column_stats", f"{_COLSTATS} SELECT col_name, pattern, value_count, input_bytes, output_bytes, round(input_bytes / output_bytes::DOUBLE, 6) AS ratio, input_bytes - output_bytes AS bytes_saved, output_bytes < input_bytes AS was_compressed FROM z")
def column_stats(spark, sf):
    return _stats(spark, sf).select("col_name", "pattern", "value_count", "input_bytes", "output_bytes", F.round("ratio", 6).alias("ratio"), "bytes_saved", "was_compressed")


@query(
    "compression_stats",
    f"""{_COLSTATS} SELECT sum(input_bytes)::BIGINT AS input_bytes, sum(output_bytes)::BIGINT AS output_bytes, count_if(pattern <> 'raw')::BIGINT AS patterns_detected, count_if(pattern IN ('sequential', 'arithmetic', 'repeated_range'))::BIGINT AS ranges_used,
    count_if(pattern IN ('repeat', 'repeated_range'))::BIGINT AS multipliers_used, count_if(pattern IN ('toggle', 'repeated_toggle'))::BIGINT AS toggles_used, sum(dict_refs)::BIGINT AS dict_refs_used, sum(raws)::BIGINT AS raw_values, count(*) AS columns_processed,
    count_if(output_bytes < input_bytes)::BIGINT AS columns_compressed, round(sum(input_bytes) / sum(output_bytes)::DOUBLE, 6) AS ratio, round(count_if(output_bytes < input_bytes) / count(*) * 100.0::DOUBLE, 6) AS column_effectiveness FROM z""",
)
def compression_stats(spark, sf):
    return E.overall_stats(_stats(spark, sf)).withColumns({"ratio": F.round("ratio", 6), "column_effectiveness": F.round("column_effectiveness", 6)})


@query(
    "compression_report",
    f"""{_COLSTATS}, w AS (SELECT *, input_bytes / output_bytes::DOUBLE AS ratio FROM z) SELECT (SELECT col_name FROM w WHERE output_bytes < input_bytes ORDER BY ratio DESC, col_idx DESC LIMIT 1) AS most_effective,
    (SELECT col_name FROM w ORDER BY ratio, col_idx LIMIT 1) AS least_effective, sum(input_bytes - output_bytes)::BIGINT AS total_bytes_saved, count_if(output_bytes < input_bytes)::BIGINT AS compressed_columns FROM w""",
)
def compression_report(spark, sf):
    return E.report(_stats(spark, sf))


@query(
    "ctx_fallback",
    f"""{_COLSTATS}, dl AS (SELECT sum(strlen(v) + 1) - 1 + strlen('$default:') + 1 AS dict_bytes FROM d), t AS (SELECT sum(input_bytes) AS original_size, 4 + coalesce((SELECT dict_bytes FROM dl), 0) + sum(strlen(col_name) + 2) + sum(output_bytes + 1) - 1 AS encoded_size FROM z)
    SELECT original_size::BIGINT AS original_size, encoded_size::BIGINT AS encoded_size, original_size / encoded_size::DOUBLE < 1.2 AS falls_back FROM t""",
)
def ctx_fallback(spark, sf):
    """Whether the table as one document would be written plain; its size is found without writing it."""
    return E.document_size(*_sizes(spark, sf))
