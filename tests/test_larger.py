"""What tables beyond the smallest bring: numbers that grow out of their types, and columns that no task should hold."""

import json
import random

import pyarrow as pa
from pyspark.sql import functions as F

from colpattern import catalog
from colpattern.config import DecodeConfig
from colpattern.errors import SyntaxProblem
from colpattern.functions import text as X
from colpattern.operators import dictionary as Dict
from colpattern.operators import encode as E
from colpattern.operators import expand as X2
from colpattern.operators import syslog as L
from colpattern.operators.runs import rle_encode
from colpattern.plans import codec
from colpattern.sources import document as D
from colpattern.sources import tables as T


def test_sizes_beyond_64_bits(spark):
    tb = 1024**4
    sizes = [0, 1023, 1024, (1 << 63) - 1, 1 << 63, 7919 * 600_000**3 + 5, 10**30, tb * 9 * 10**7 + tb // 8, tb * 9 * 10**7 + 3 * tb // 8, tb * 9 * 10**7 + tb - 1]
    t = spark.createDataFrame([(str(n),) for n in sizes], "n string").select(X.format_bytes(F.col("n").cast("decimal(38,0)")).alias("r"))
    got = [r["r"] for r in t.collect()]
    assert got[:4] == ["0 B", "1023 B", "1.00 KB", "8388608.00 TB"]
    for n, g in zip(sizes[4:], got[4:], strict=True):
        h, rest = divmod(n * 100, tb)
        h += rest * 2 > tb or (rest * 2 == tb and h % 2 == 1)
        assert g == f"{h // 100}.{h % 100:02d} TB"


def test_format_bytes_of_many_events(spark, tmp_path):
    spark.createDataFrame([(i, i % 7) for i in (0, 5, 99_999, 600_000, 36_000_000)], "event_id long, user_id long").write.parquet(str(tmp_path / "events.parquet"))
    got = {r["event_id"]: r["readable"] for r in catalog.queries()["format_bytes"](spark, str(tmp_path)).collect()}
    assert got[5] == "966.68 KB" and got[36_000_000].endswith(" TB") and float(got[600_000][:-3]) == round(7919 * 600_000**3 / 1024**4, 2)


def test_sizes_are_those_of_streams(spark):
    n = 240
    columns = {
        "id": [str(i) for i in range(n)], "two words": ["red", "a>b (c)", "red", "007"] * (n // 4), "raw": [f"x{i * i % 17}" for i in range(n)], "once": [f"né {i * 7919 % n}" for i in range(n)],
        "const": ["same"] * n, "empty": ["\\e", "\\0"] * (n // 2), "mixed": ["12", "x3", "long text that pays"] * (n // 3 - 1) + ["q", "q", "5"],
    }
    rows = [(c, name, i, "string" if name != "id" else "integer", v) for c, (name, vs) in enumerate(columns.items()) for i, v in enumerate(vs)]
    cells = spark.createDataFrame(rows, "col_idx int, col_name string, rid long, kind string, v string")
    entries = Dict.build(Dict.frequencies(cells))
    want = E.column_stats(E.streams(cells.withColumn("chunk", F.lit(0)), E.choose(cells.withColumn("chunk", F.lit(0)), ["chunk"]), entries.withColumn("chunk", F.lit(0)), ["chunk"]))
    got = E.sizes(cells, entries)
    assert sorted(map(tuple, got.select(want.columns).collect())) == sorted(map(tuple, want.collect()))
    whole = E.documents(cells.withColumn("chunk", F.lit(0)), ["chunk"]).first()
    size = E.document_size(got, entries).first()
    assert (size["original_size"], size["encoded_size"], size["falls_back"]) == (whole["original_size"], whole["encoded_size"], whole["format"] == "ctx")


def test_no_task_gathers_a_column(spark):
    """A whole column as one array or one Arrow table is what these queries failed by."""
    for name in ("ctx_fallback", "column_stats", "compression_stats", "compression_report"):
        plan = catalog.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert "collect_list" not in plan and "ApplyInArrow" not in plan and "FlatMapGroups" not in plan, name


def test_operators_of_many_documents_come_in_small_batches():
    """A batch of 10,000 documents was one table of Python objects: 24 GB of a worker at 6 GB."""
    text = "!v1\n$default:aa|bb\n#a #b\n" + " ".join(f"x{i}" for i in range(300)) + "|" + " ".join("_0 _1 7".split() * 100)
    docs = pa.record_batch({"chunk": pa.array(range(50), pa.int64()), "document": pa.array([text] * 50)})
    got = list(D._parse_rows(iter([docs]), "chunk", "document", DecodeConfig()))
    assert max(b.num_rows for b in got) <= 600 and sum(b.num_rows for b in got) == 50 * 600


def test_shapes_are_those_of_operator_rows(spark):
    texts = [
        "!v1\n#a #b\n1>5 x*3 (1>2)*2|p~q*7 _0", "!v1\n$default:aa|b\\|b\n#na\\ me #b\n_0 _1*2 a\\ b -3 4.50|x y 1 2 z", "!v1\n#a\n\\0 \\e é (a~b*3)*2 k *2 7 > 9 u ~ v*2", "!v1\n#a #b\n|", "!v1\n#a\n5>1:-2 0.5 -0.25 007 1e3 a_b a#b a!b\n",
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "chunk long, document string")
    ops = D.parse_documents(docs)
    want = X2.validate(ops, ["chunk"]).join(X2.info(ops, ["chunk"]), "chunk")
    got = codec.info(docs)
    assert sorted(map(tuple, got.select(want.columns).collect())) == sorted(map(tuple, want.collect())) and got.count() == 4
    assert {r["chunk"]: r["document_bytes"] for r in got.collect()} == {i: len(t.encode()) for i, t in enumerate(texts) if i != 3}


def test_plain_values_are_read_as_by_the_scanner():
    """The short way for values that stand alone, against the tokens one by one."""
    rng = random.Random(3)
    parts = ["a", "_0", "_12", "_", "7", "-3", "0.5", "1.50", "007", "x*2", "x *2", "1>3", "1 >3", "a~b", "a ~b*3", "(a)*2", "\\0", "\\e", "a\\ b", "é", "a_b", "1a", "-0.5", "1e5", "12345678901234567890123", "\\q7", "b!", "b$c"]
    for _ in range(500):
        text = "!v1\n#a #b\n" + rng.choice([" ", "  ", "\t"]).join(rng.choices(parts, k=8)) + "|" + " ".join(rng.choices(parts, k=5)) + rng.choice(["", "\n", " "])
        slow = D.Parser(text)
        head = slow.head()
        slow.s.peek()
        fast = D.Parser(text)
        def ops(parser, one_by_one):
            out = [[]]
            try:
                if not one_by_one:
                    return parser.document().streams
                while (t := parser.s.next())[0] != "end":
                    if t[0] == "|":
                        out.append([])
                    elif t[0] != "newline":
                        out[-1].append(parser._element(t))
                return out
            except SyntaxProblem as e:
                return type(e)
        assert head.schema == ["a", "b"] and ops(fast, False) == ops(slow, True), text


def test_json_array_is_read_in_blocks(spark, tmp_path):
    """The array was one value of one task. Braces, quotes and escapes stand in strings; blocks end anywhere."""
    rows = [{"id": i, "s": 'a}{"]\\' * (i % 4), "u": {"n": {}, "m": [i, {"k": "}"}]}} for i in range(300)]
    (tmp_path / "a.json").write_text(json.dumps(rows, indent=1))
    (tmp_path / "none.json").write_text(" [ ]\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "701b")
    try:
        got = {(r["rid"], r["col_name"]): r["v"] for r in T.read_json(spark, str(tmp_path / "a.json")).collect()}
        assert T.read_json(spark, str(tmp_path / "none.json")).count() == 0
        T.write_json(spark.createDataFrame([(r["id"], json.dumps(r)) for r in rows], "rid long, json string"), str(tmp_path / "b"))
        parts = {(r["rid"], r["col_name"]): r["v"] for r in T.read_json(spark, str(tmp_path / "b")).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert len(got) == 900 and parts == got
    assert all(got[i, "s"] == (rows[i]["s"] or "") or not rows[i]["s"] for i in range(300)) and got[299, "u.m"] == '[299,{"k":"}"}]'
    assert "".join(p.read_text() for p in sorted((tmp_path / "b").glob("part-*"))).startswith("[{") and len(json.loads("".join(p.read_text() for p in sorted((tmp_path / "b").glob("part-*"))))) == 300


def test_rows_of_files_are_numbered_without_a_sort(spark, tmp_path):
    for k in range(3):
        (tmp_path / f"{k}.log").write_text("".join(f"{k * 1000 + i}\n" for i in range(1000)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "999b")
    try:
        t = T.read_lines(spark, str(tmp_path))
        assert all(int(r["line"]) == r["rid"] for r in t.collect()) and t.count() == 3000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert "rangepartitioning" not in t._jdf.queryExecution().executedPlan().toString()


def test_log_codec_shuffles_lines_once(spark):
    """Windows, joins and gathered runs of ten cells a line held 4 GB in a task at 6 GB."""
    lines = [f"Jun {i % 28 + 1} 10:00:0{i // 4 % 10} combo {'ab'[i // 5 % 2]}[{i // 3}]: session opened for user u{i % 3} by (uid=0)" for i in range(60)] + ["garbage", "Dec 1 01:02:03 h cups: cupsd shutdown succeeded"]
    t = spark.createDataFrame([(i % 2, 1000 - i, v) for i, v in enumerate(lines)], "chunk int, rid long, line string")
    got = L.codec(t)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Window" not in plan and "collect_list" not in plan
    docs = {r["chunk"]: r["document"].split("\n") for r in got.collect()}
    assert docs[1][:4] == ["!L1", "$S:cups|b|a", "$I:", "$U:u2|u0|u1"] and docs[0][1] == "$S:b|a"
    cells = L.compact(t).where("parsed AND chunk = 1").orderBy("rid").select("second", "pid").collect()
    for line, name in ((docs[1][8], "second"), (docs[1][10], "pid")):
        values = column(spark, [None if r[name] is None else str(r[name]) for r in cells])
        assert line == f"@{'S' if name == 'second' else 'p'}:" + rle_encode(values).first()["encoded"]


def column(spark, values):
    return spark.createDataFrame(list(enumerate(values)), "rid long, v string")
