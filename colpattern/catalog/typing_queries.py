"""Sources, cells, types and escape functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from colpattern.catalog import inputs as I
from colpattern.catalog.registry import query, table
from colpattern.functions import cells as C
from colpattern.functions import text as X
from colpattern.sources import tables as T
from colpattern.storage import fresh_path

_TRIM = "trim(t, ' ' || chr(9) || chr(10) || chr(13))"
_TYPED = f"WITH {I.FIELDS_SQL}, k AS (SELECT event_id, t, {_TRIM} AS u FROM f), c AS (SELECT event_id, t, u, CASE WHEN t IS NULL OR t = '' THEN 'null' ELSE {I.kind_sql('u')} END AS kind FROM k)"
_BOOL = "CASE WHEN lower(u) IN ('true','yes','y','t','1') THEN true WHEN lower(u) IN ('false','no','n','f','0') THEN false END"


@query("infer_value_kind", f"{_TYPED} SELECT event_id, kind, CASE WHEN kind = 'integer' THEN try_cast(u AS BIGINT) END AS ival FROM c")
def infer_value_kind(spark, sf):
    t = I.fields(spark, sf)
    return t.select("event_id", C.csv_kind(F.col("t")).alias("kind"), F.when(C.csv_kind(F.col("t")) == "integer", C.as_integer(C.trim(F.col("t")))).alias("ival"))


@query("parse_boolean", f"{_TYPED} SELECT event_id, {_BOOL.replace('(u)', '(t)')} AS b FROM c")
def parse_boolean(spark, sf):
    return I.fields(spark, sf).select("event_id", C.parse_boolean(F.col("t")).alias("b"))


@query("kind_predicates", f"{_TYPED} SELECT event_id, kind = 'null' AS is_null, kind = 'integer' AS is_integer, kind = 'float' AS is_float, kind = 'string' AS is_string, kind = 'boolean' AS is_boolean FROM c")
def kind_predicates(spark, sf):
    k = C.csv_kind(F.col("t"))
    return I.fields(spark, sf).select("event_id", *[(k == n).alias(f"is_{n}") for n in ("null", "integer", "float", "string", "boolean")])


@query(
    "typed_accessors",
    f"""{_TYPED} SELECT event_id, CASE WHEN kind = 'integer' THEN try_cast(u AS BIGINT) END AS as_integer,
    CASE WHEN kind IN ('integer', 'float') AND lower(u) NOT IN ('inf', 'nan') THEN try_cast(u AS DOUBLE) END AS as_float,
    CASE WHEN kind = 'string' THEN CASE WHEN t = '\\e' THEN '' ELSE t END END AS as_string, CASE WHEN kind = 'boolean' THEN {_BOOL} END AS as_boolean FROM c""",
)
def typed_accessors(spark, sf):
    """Typed views of cells; infinities and NaN are left out of the comparison."""
    kind, text = C.csv_kind(F.col("t")), C.csv_repr(F.col("t"))
    got = C.typed(kind, text)
    got["as_float"] = F.when(~text.isin("inf", "NaN"), got["as_float"])
    return I.fields(spark, sf).select("event_id", *[v.alias(k) for k, v in got.items()])


_FLOAT_TEXT = r"regexp_replace(CAST({x} AS VARCHAR), '\.0$', '')"


@query(
    "value_repr",
    f"""SELECT event_id, CAST(user_id AS VARCHAR) AS i, {_FLOAT_TEXT.format(x="value")} AS f, event_type AS s, CASE WHEN user_id % 2 = 0 THEN 'true' ELSE 'false' END AS b,
    CASE WHEN event_id % 7 = 0 THEN '\\0' ELSE {_FLOAT_TEXT.format(x="-value")} END AS n FROM events""",
)
def value_repr(spark, sf):
    e = table(spark, sf, "events")
    t = e.select("event_id", F.col("user_id").alias("i"), F.col("value").alias("f"), F.col("event_type").alias("s"), (F.col("user_id") % 2 == 0).alias("b"), F.when(F.col("event_id") % 7 != 0, -F.col("value")).alias("n"))
    return t.select("event_id", *[C.value_repr(F.col(x.name), x.dataType).alias(x.name) for x in t.schema.fields[1:]])


_TYPE = """CASE WHEN s + b + i + f = 0 OR s = 1 THEN 'string' WHEN b + i + f = 1 THEN CASE WHEN i = 1 THEN 'integer' WHEN f = 1 THEN 'float' ELSE 'boolean' END
    WHEN f = 1 AND i = 1 THEN 'float' ELSE 'mixed' END"""
_FLAGS = ", ".join(f"max(CASE WHEN kind = '{k}' THEN 1 ELSE 0 END) AS {k[0]}" for k in ("string", "boolean", "integer", "float"))


@query("infer_column_type", f"{_TYPED}, g AS (SELECT event_id % 97 AS grp, {_FLAGS} FROM c GROUP BY 1) SELECT grp, {_TYPE} AS column_type FROM g")
def infer_column_type(spark, sf):
    """The type of each of 97 columns that the texts are dealt to."""
    t = I.fields(spark, sf).select((F.col("event_id") % 97).alias("grp"), C.csv_kind(F.col("t")).alias("kind"))
    return t.groupBy("grp").agg(C.column_type(F.col("kind")).alias("column_type"))


@query("can_represent", f"{_TYPED} SELECT event_id, ct AS column_type, kind = 'null' OR ct = 'mixed' OR ct = kind OR (ct = 'float' AND kind = 'integer') AS fits FROM c, (SELECT unnest(['integer', 'float', 'string', 'boolean', 'mixed']) AS ct)")
def can_represent(spark, sf):
    t = I.fields(spark, sf).select("event_id", C.csv_kind(F.col("t")).alias("kind"), F.explode(F.array(*map(F.lit, ("integer", "float", "string", "boolean", "mixed")))).alias("column_type"))
    return t.select("event_id", "column_type", C.can_represent(F.col("column_type"), F.col("kind")).alias("fits"))


@query("decode_types", f"WITH {I.FIELDS_SQL}, c AS (SELECT event_id, t, t AS u, CASE WHEN t IS NULL OR t IN ('', '\\0') THEN 'null' WHEN t = '\\e' THEN 'string' ELSE {I.kind_sql('t')} END AS kind FROM f) SELECT event_id, kind, CASE WHEN kind = 'integer' THEN try_cast(u AS BIGINT) END AS ival, CASE WHEN kind = 'boolean' THEN {_BOOL} END AS bval, CASE WHEN kind = 'string' THEN CASE WHEN t = '\\e' THEN '' ELSE t END END AS sval FROM c")
def decode_types(spark, sf):
    """How cells of an expanded document are typed again."""
    kind, text = C.decoded_kind(F.col("t")), C.decoded_text(F.col("t"))
    return I.fields(spark, sf).select("event_id", kind.alias("kind"), F.when(kind == "integer", C.as_integer(text)).alias("ival"), F.when(kind == "boolean", C.parse_boolean(text)).alias("bval"), F.when(kind == "string", text).alias("sval"))


@query("project_columns", "SELECT event_id, event_type FROM events")
def project_columns(spark, sf):
    return table(spark, sf, "events").select("event_id", "event_type")


@query("row_at", "SELECT event_id, user_id, event_type, value FROM events WHERE event_id = (SELECT count(*) // 2 FROM events)")
def row_at(spark, sf):
    """The row in the middle, by its index."""
    e = table(spark, sf, "events")
    n = e.agg(F.floor(F.count("*") / 2).alias("m"))
    return e.join(F.broadcast(n), F.col("event_id") == F.col("m")).select("event_id", "user_id", "event_type", "value")


# ---------------------------------------------------------------- escapes
_ESC = r"""replace(replace(replace(regexp_replace({t}, '([>*~|_#$:\\ ])', '\\\1', 'g'), chr(10), '\n'), chr(9), '\t'), chr(13), '\r')"""
_UNESC = r"""CASE WHEN regexp_full_match({t}, '(?s)(\\[>*~|_#$:\\ ntr0e]|[^\\])*') THEN array_to_string(list_transform(regexp_extract_all({t}, '(?s)\\.|[^\\]'),
    lambda x: CASE x WHEN '\n' THEN chr(10) WHEN '\t' THEN chr(9) WHEN '\r' THEN chr(13) WHEN '\0' THEN '' WHEN '\e' THEN '' ELSE CASE WHEN length(x) = 2 THEN x[2] ELSE x END END), '') END"""
_S = f"WITH {I.SPECIALS_SQL}"


@query("escape_text", f"{_S} SELECT event_id, {_ESC.format(t='t')} AS escaped FROM s")
def escape_text(spark, sf):
    return I.specials(spark, sf).select("event_id", X.escape(F.col("t")).alias("escaped"))


@query("unescape_text", f"{_S}, e AS (SELECT event_id, t, {_ESC.format(t='t')} AS e FROM s) SELECT event_id, {_UNESC.format(t='t')} AS plain, {_UNESC.format(t='e')} AS back FROM e")
def unescape_text(spark, sf):
    """Texts read as if they were escaped (null where they can't be), and escaped texts read back."""
    t = F.col("t")
    return I.specials(spark, sf).select("event_id", X.unescape(t).alias("plain"), X.unescape(X.escape(t)).alias("back"))


@query("token_tests", f"{_S} SELECT event_id, t = '\\0' AS is_null_token, t = '\\e' AS is_empty_token FROM s")
def token_tests(spark, sf):
    t = F.col("t")
    return I.specials(spark, sf).select("event_id", X.is_null_token(t).alias("is_null_token"), X.is_empty_token(t).alias("is_empty_token"))


@query("encode_value", f"{_S} SELECT event_id, CASE WHEN t IS NULL THEN '\\0' WHEN t = '' THEN '\\e' ELSE {_ESC.format(t='t')} END AS encoded FROM s")
def encode_value(spark, sf):
    return I.specials(spark, sf).select("event_id", X.encode_value(F.col("t")).alias("encoded"))


@query("decode_value", f"{_S} SELECT event_id, CASE WHEN t = '\\0' THEN NULL WHEN t = '\\e' THEN '' ELSE {_UNESC.format(t='t')} END AS decoded FROM s")
def decode_value(spark, sf):
    return I.specials(spark, sf).select("event_id", X.decode_value(F.col("t")).alias("decoded"))


@query("needs_escaping", _S + r" SELECT event_id, regexp_matches(t, '[>*~|_#$:\\\n\t\r ]') AS needs FROM s")
def needs_escaping(spark, sf):
    return I.specials(spark, sf).select("event_id", X.needs_escaping(F.col("t")).alias("needs"))


@query("escape_dict", _S + r" SELECT event_id, replace(replace(replace(replace(t, '\', '\\'), '|', '\|'), chr(10), '\n'), chr(13), '\r') AS escaped FROM s")
def escape_dict(spark, sf):
    return I.specials(spark, sf).select("event_id", X.escape_dictionary(F.col("t")).alias("escaped"))


@query("escape_name", _S + r" SELECT event_id, replace(replace(replace(replace(replace(replace(t, '\', '\\'), ' ', '\ '), chr(10), '\n'), chr(13), '\r'), chr(9), '\t'), '#', '\#') AS escaped FROM s")
def escape_name(spark, sf):
    return I.specials(spark, sf).select("event_id", X.escape_name(F.col("t")).alias("escaped"))


_BYTES = "(event_id * event_id * event_id * 7919 + user_id)"


@query(
    "format_bytes",
    f"""WITH b AS (SELECT event_id, {_BYTES} AS n FROM events) SELECT event_id, CASE WHEN n < 1024 THEN CAST(n AS VARCHAR) || ' B'
    WHEN n < 1048576 THEN printf('%.2f', n / 1024.0::DOUBLE) || ' KB' WHEN n < 1073741824 THEN printf('%.2f', n / 1048576.0::DOUBLE) || ' MB'
    WHEN n < 1099511627776 THEN printf('%.2f', n / 1073741824.0::DOUBLE) || ' GB' ELSE printf('%.2f', n / 1099511627776.0::DOUBLE) || ' TB' END AS readable FROM b""",
)
def format_bytes(spark, sf):
    """Sizes that leave 64 bits from event 105,214 on, so they are worked out as decimals."""
    wide = _BYTES.replace("event_id", "CAST(event_id AS DECIMAL(38,0))", 1)
    return table(spark, sf, "events").select("event_id", F.expr(wide).alias("n")).select("event_id", X.format_bytes(F.col("n")).alias("readable"))


# ---------------------------------------------------------------- sources and sinks
@query("detect_format", f"""WITH {I.SPECIALS_SQL}, n AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'x.csv' WHEN 1 THEN 'x.json' WHEN 2 THEN 'x.colp' ELSE '-' END AS name,
    CASE event_id % 5 WHEN 0 THEN '  [1]' WHEN 1 THEN '{{"a":1}}' WHEN 2 THEN '!v1' WHEN 3 THEN '#id' ELSE coalesce(t, '') END AS content FROM s)
    SELECT event_id, CASE WHEN name LIKE '%.csv' THEN 'csv' WHEN name LIKE '%.json' THEN 'json' WHEN name LIKE '%.colp' THEN 'document'
    WHEN regexp_matches(ltrim(content), '^[\\[{{]') THEN 'json' WHEN regexp_matches(ltrim(content), '^(![vx]|!ctx|#|\\$)') THEN 'document' ELSE 'csv' END AS format FROM n""")
def detect_format(spark, sf):
    t = I.specials(spark, sf)
    name = I.pick(("x.csv", "x.json", "x.colp", "-"), F.col("event_id"))
    k = F.col("event_id") % 5
    content = F.when(k == 0, "  [1]").when(k == 1, '{"a":1}').when(k == 2, "!v1").when(k == 3, "#id").otherwise(F.coalesce("t", F.lit("")))
    return t.select("event_id", T.detect_format(name, content).alias("format"))


_WIDE = "SELECT event_id, CAST(user_id AS {str}) AS usr, event_type AS etype, CASE WHEN event_id % 3 = 0 THEN 'yes' ELSE 'no' END AS flag, CASE WHEN event_id % 4 = 0 THEN NULL ELSE 'a, \"' || event_type || '\"' END AS note FROM events"


def _wide(spark, sf):
    e = table(spark, sf, "events")
    note = F.when(F.col("event_id") % 4 != 0, F.concat(F.lit('a, "'), F.col("event_type"), F.lit('"')))
    return e.select(F.col("event_id").alias("rid"), F.col("user_id").cast("string").alias("usr"), F.col("event_type").alias("etype"), F.when(F.col("event_id") % 3 == 0, "yes").otherwise("no").alias("flag"), note.alias("note"))


@query(
    "scan_csv_infer",
    f"""WITH w AS ({_WIDE.format(str="VARCHAR")}) SELECT event_id AS rid, 'usr' AS col_name, 'integer' AS kind, usr AS v FROM w UNION ALL SELECT event_id, 'etype', 'string', etype FROM w
    UNION ALL SELECT event_id, 'flag', 'boolean', CASE flag WHEN 'yes' THEN 'true' ELSE 'false' END FROM w UNION ALL SELECT event_id, 'note', CASE WHEN note IS NULL THEN 'null' ELSE 'string' END, coalesce(note, '\\0') FROM w""",
)
def scan_csv_infer(spark, sf):
    """The table written as CSV, read again, and every field typed."""
    at = fresh_path(spark, "csv")
    T.write_csv(_wide(spark, sf), at)
    return C.to_cells(T.read_csv(spark, at), "rid", infer=True).select("rid", "col_name", "kind", "v")


@query("csv_write", f"""WITH w AS ({_WIDE.format(str="VARCHAR")}) SELECT event_id AS rid, usr || ',' || etype || ',' || flag || ',' || CASE WHEN note IS NULL THEN '' ELSE '"' || replace(note, '"', '""') || '"' END AS line FROM w""")
def csv_write(spark, sf):
    return T.csv_lines(_wide(spark, sf))


def _nested(spark, sf):
    e = table(spark, sf, "events")
    return e.select(F.col("event_id").alias("rid"), F.col("event_id").alias("id"), F.col("user_id").alias("user.id"), F.col("event_type").alias("user.last.kind"), F.col("value"), F.when(F.col("event_id") % 2 == 0, F.col("props")).alias("note"))


@query("json_unflatten", """SELECT event_id AS rid, CAST(json_object('id', event_id, 'user', json_object('id', user_id, 'last', json_object('kind', event_type)), 'value', value,
    'note', CASE WHEN event_id % 2 = 0 THEN props END) AS VARCHAR) AS json FROM events""")
def json_unflatten(spark, sf):
    return T.json_rows(_nested(spark, sf))


_FLAT = """SELECT event_id AS rid, 'id' AS path, 'integer' AS kind, CAST(event_id AS VARCHAR) AS v FROM events UNION ALL SELECT event_id, 'user.id', 'integer', CAST(user_id AS VARCHAR) FROM events
    UNION ALL SELECT event_id, 'user.last.kind', 'string', event_type FROM events UNION ALL SELECT event_id, 'props.k', 'integer', json_extract_string(props, '$.k') FROM events
    UNION ALL SELECT event_id, 'tags', 'string', '[' || user_id || ',"x"]' FROM events UNION ALL SELECT event_id, 'none', 'null', '\\0' FROM events
    UNION ALL SELECT event_id, 'ok', CASE WHEN event_id % 2 = 0 THEN 'boolean' ELSE 'string' END, CASE WHEN event_id % 2 = 0 THEN 'true' ELSE 'text' END FROM events"""


def _objects(spark, sf):
    e = table(spark, sf, "events")
    id_, user, ok = F.col("event_id").cast("string"), F.col("user_id").cast("string"), F.when(F.col("event_id") % 2 == 0, "true").otherwise('"text"')
    parts = ['{"id":', id_, ',"user":{"id":', user, ',"last":{"kind":"', F.col("event_type"), '"}},"props":', F.col("props"), ',"tags":[', user, ',"x"],"none":null,"empty":{},"ok":', ok, "}"]
    return e.select(F.col("event_id").alias("rid"), F.concat(*[p if not isinstance(p, str) else F.lit(p) for p in parts]).alias("json"))


@query("json_flatten", _FLAT.replace(" AS path", " AS path"))
def json_flatten(spark, sf):
    """Leaves of an object per row."""
    return T.flatten(_objects(spark, sf).select("rid", F.parse_json("json").alias("v")), ["rid"])


@query("scan_json_flatten", _FLAT.replace(" AS path", " AS col_name"))
def scan_json_flatten(spark, sf):
    """One array of objects, written from the table and read again."""
    at = fresh_path(spark, "json")
    T.write_json(_objects(spark, sf), at)
    return T.read_json(spark, at).select("rid", "col_name", "kind", "v")
