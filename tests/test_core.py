"""Golden documents, round trips, and the parts that SQL does not check."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from colpattern import cli
from colpattern.config import DecodeConfig, EncodeConfig
from colpattern.errors import ColumnMismatch, InputTooLarge, InvalidReference, RangeOverflow, SyntaxProblem, VersionMismatch
from colpattern.functions import cells as C
from colpattern.functions import text as X
from colpattern.operators import chunk
from colpattern.operators import dictionary as Dict
from colpattern.operators import encode as E
from colpattern.operators import syslog as L
from colpattern.operators.rows import global_rank, with_previous, with_rid
from colpattern.operators.runs import arithmetic_segments, find_runs, longest_run, rle_encode
from colpattern.plans import codec
from colpattern.pretty import pretty, token
from colpattern.sources import document as D
from colpattern.sources import tables as T


def column(spark, values, name="v"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"rid long, {name} string")


# ------------------------------------------------ documents
GOLDEN = {
    ("id", "status"): ([(i, "active") for i in range(1, 11)], "!v1\n$default:active\n#id #status\n1>10|active*10"),
    ("id", "name"): ([(1, "Alice"), (2, "Bob"), (3, "Charlie")], "!ctx\n#id #name\n1 2 3|Alice Bob Charlie"),
    ("flag",): ([(b,) for b in (True, False) * 4], "!v1\n#flag\n(true~false*4)*2"),
    ("k",): ([(i % 25,) for i in range(100)], "!v1\n#k\n(0>24)*4"),
    ("x",): ([(c,) for c in "ABC" * 4], "!v1\n#x\nA~B~C*12"),
    ("a", "b"): ([(1, None), (None, 2), (4, 5)], "!ctx\n#a #b\n1 \\\\0 4|\\\\0 2 5"),
}


def test_golden_documents(spark):
    """All of them as chunks of one job, keyed by their number."""
    from functools import reduce

    parts = []
    for k, (names, (rows, _)) in enumerate(GOLDEN.items()):
        t = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], ["rid", *names])
        parts.append(C.to_cells(t).withColumn("chunk", F.lit(k)))
    docs = E.documents(reduce(lambda a, b: a.unionByName(b), parts), ["chunk"])
    got = {r["chunk"]: r for r in docs.collect()}
    for k, (_, want) in enumerate(GOLDEN.values()):
        assert got[k]["document"] == want
    assert (got[0]["original_size"], got[0]["encoded_size"]) == (99, 46)


def test_parse_and_expand():
    def values(text):
        return [r[0] for r in D.parse("#c\n" + text).rows()]

    assert values("1>5") == list("12345") and values("10>50:10") == ["10", "20", "30", "40", "50"] and values("5>1:-1") == list("54321")
    assert values("(1>3)*2") == values("1>3*2") == list("123123")
    assert values("T~F*4") == list("TFTF") and values("T~F") == list("TF")
    with pytest.raises(InvalidReference):
        values("_0*2")
    assert values("1>5:-1") == [] and values("a\\ b \\q2024-01-01 \\(x\\)") == ["a b", "2024-01-01", "(x)"]
    doc = D.parse("$default:red|blue\n#a #b\n(_0)*2 _1|1>3")
    assert doc.rows() == [["red", "1"], ["red", "2"], ["blue", "3"]]
    assert [token(o) for o in doc.streams[0]] == ["_0*2", "_1"] and "red, red" in pretty(doc, True)
    for text, kind in (("!v2\n#a\n1", VersionMismatch), ("#a #b\n1", ColumnMismatch), ("#a\nx\\y", SyntaxProblem), ("#a\n1>99999999", RangeOverflow), ("#a\n-", SyntaxProblem), ("#a\n(1>3", SyntaxProblem)):
        with pytest.raises(kind):
            D.parse(text)


def test_number_text(spark):
    for f, want in ((1.0, "1"), (1e-10, "0.0000000001"), (1e16, "10000000000000000"), (-2.5, "-2.5"), (9.87e15, "9870000000000000"), (1.23e-15, "0.00000000000000123"), (float("inf"), "inf"), (-0.0, "-0"), (123456.789, "123456.789")):
        assert D.number_text(f) == want
        assert spark.range(1).select(C.float_text(F.lit(f))).first()[0] == want


def test_values_that_look_like_syntax_come_back(spark):
    odd = ["2024-01-01", "3-MEDIUM", "12abc", "-", "!v9", "(a)", "a>b", "x*3", "p~q", "_7", "#c", "$d", "k:v", "a|b", "back\\slash", "two\nlines", "tab\t", "sp ace", "", None, "日本>語", "1.50", "007", "+5", "1e3", "-0"]
    t = column(spark, odd, "c")
    docs = codec.compress(t, dense="rid", chunk_rows=None, drop_index=True)
    back = codec.decompress(docs, schema=t.select("c").schema).orderBy("rid")
    assert [r["c"] for r in back.collect()] == odd
    with pytest.raises(Exception, match="compatible"):
        codec.compress(column(spark, ["(a)"] * 9, "c"), dense="rid", chunk_rows=None, drop_index=True, config=EncodeConfig(compat=True)).collect()


# ------------------------------------------------ detection against a plain model
def model(v):
    """The rules, value by value."""
    n, size = len(v), sum(map(len, v)) + len(v) - 1
    if n < 3:
        return "raw"

    def integer(x):
        try:
            return int(x.strip())
        except ValueError:
            return None

    def span(w):
        x = [integer(s) for s in w]
        if len(x) < 2 or None in x or x[1] == x[0] or any(a != x[0] + i * (x[1] - x[0]) for i, a in enumerate(x)):
            return None
        step = x[1] - x[0]
        cost = len(str(x[0])) + 1 + len(str(x[-1])) + (0 if abs(step) == 1 else 1 + len(str(step)))
        return (cost, step) if (sum(map(len, w)) + len(w) - 1) / cost > 1 else None

    def cycle(w):
        for k in range(2, min(len(w), 8) + 1):
            if len(set(w[:k])) > 1 and all(a == w[i % k] for i, a in enumerate(w)):
                cost = sum(map(len, w[:k])) + k - 1 + 1 + len(str(len(w)))
                return cost if (sum(map(len, w)) + len(w) - 1) / cost > 1 else None
        return None

    best = ("raw", 1.0)

    def offer(name, ratio):
        nonlocal best
        if ratio > 1 and ratio > best[1] + 1e-12:
            best = (name, ratio)

    if span(v):
        offer("sequential" if abs(span(v)[1]) == 1 else "arithmetic", size / span(v)[0])
    if len(set(v)) == 1:
        offer("repeat", size / (len(v[0]) + 1 + len(str(n))))
    if cycle(v):
        offer("toggle", size / cycle(v))
    if n >= 4:
        for name, test in (("repeated_range", span), ("repeated_toggle", cycle)):
            for p in range(2, n // 2 + 1):
                if n % p == 0 and all(v[i] == v[i % p] for i in range(n)) and test(v[:p]):
                    offer(name, size / (span(v[:p])[0] + 3 + len(str(n // p))) if test is span else size / (11 + __import__("math").log10(n // p)))
                    break
    return best[0]


def test_detection_follows_the_rules(spark):
    rng = random.Random(7)
    columns = []
    for _ in range(400):
        n, kind = rng.randrange(1, 41), rng.randrange(5)
        base = [str(rng.randrange(-9, 300) + i * rng.choice([-3, -1, 1, 2, 10])) for i in range(1)]
        if kind == 0:
            a, s = rng.randrange(-50, 300), rng.choice([-3, -1, 1, 2, 10])
            v = [str(a + i * s) for i in range(n)]
        elif kind == 1:
            c = [rng.choice(["a", "bb", "on", "off", "true"]) for _ in range(rng.randrange(1, 9))]
            v = [c[i % len(c)] for i in range(n)]
        elif kind == 2:
            p, a, s = rng.randrange(2, 9), rng.randrange(100), rng.choice([1, -1, 5])
            v = [str(a + i % p * s) for i in range(n)]
        elif kind == 3:
            p, k = rng.randrange(2, 12), rng.randrange(2, 5)
            v = ["xyzw"[i % p % k] * 3 for i in range(n)]
        else:
            v = base * n
        if rng.random() < 0.2:
            v[rng.randrange(n)] = "odd"
        columns.append(v)
    columns += [["9223372036854775806", "9223372036854775807", "9223372036854775808"], ["-9223372036854775808", "0", "9223372036854775807"], ["+1", "+2", "+3"], [" 1", "2 ", "3"], ["01", "02", "03", "01", "02", "03"], ["4611686018427387904", "4611686018427387905", "4611686018427387906"], ["a"], ["7"], ["a", "b"]]
    cells = spark.createDataFrame([(k, f"c{k}", "string", i, x) for k, v in enumerate(columns) for i, x in enumerate(v)], "col_idx int, col_name string, kind string, rid long, v string")
    found = {r["col_idx"]: r for r in E.choose(cells).collect()}
    for k, v in enumerate(columns):
        own = chunk.detect(chunk._Column(*encoded(v)))
        assert found[k]["pattern"] == own.pattern == (model(v) if k < 400 else own.pattern), (v, found[k]["pattern"], own, model(v))
        assert found[k]["operator"] == own.token and found[k]["ratio"] == pytest.approx(own.ratio), v


def encoded(values):
    a = pa.array(values, pa.string()).dictionary_encode()
    return a.indices.to_numpy(), a.dictionary.to_pylist()


def test_chunk_texts_are_the_column_texts(spark):
    """Tokens, dictionary and plain text of the Arrow pass against the Column expressions."""
    rng = random.Random(3)
    odd = ["2024-01-01", "12abc", "-", "!v9", "(a)", "a>b c", "x*3", "_7", "back\\slash", "two\nlines", "", "\\0", "\\e", "日本>語", "1.50", "007", "+5", "1e3", "-0", "12\n", "true", "0.5", "-17.25", "123456789012345678", "1234567890123456789"]
    values = [rng.choice(odd) for _ in range(300)]
    t = column(spark, values)
    assert [r[0] for r in t.orderBy("rid").select(E.literal(F.col("v"))).collect()] == [chunk.literal(v) for v in values]
    entries = {r["v"]: r["dict_idx"] for r in Dict.build(t.groupBy("v").agg(F.count("*").alias("n"))).collect()}
    assert entries == chunk.build_dictionary({v: values.count(v) for v in values}, 65_536)


def test_limits_and_empty_tables(spark):
    t = spark.createDataFrame([], "rid long, a int, `b c` string")
    docs = codec.compress(t, dense="rid", drop_index=True)
    assert [r["document"] for r in docs.collect()] == ["!v1\n#a #b\\ c\n|"]
    back = codec.decompress(docs)
    assert back.columns == ["chunk", "rid", "a", "b c"] and back.count() == 0
    assert codec.to_array(codec.compress(column(spark, ["1", "2"]), dense="rid", infer=True, drop_index=True)).tolist() == [[1], [2]]
    full = column(spark, ["some text"] * 4 + ["other text"] * 3 + ["x"])
    _, stats, use = codec.compress_with_stats(codec.chunked_cells(full, dense="rid", drop_index=True))
    assert [(r["dict_refs"], r["raws"], r["was_compressed"]) for r in stats.collect()] == [(7, 1, True)]
    assert [tuple(r)[1:] for r in use.collect()] == [(2, 1.0, 1.0)]
    with pytest.raises(Exception, match="allowed"):
        codec.compress(full, dense="rid", config=EncodeConfig(max_input_size=20)).collect()
    with pytest.raises(InputTooLarge):
        D.parse("#a\n1", DecodeConfig(max_input_size=3))
    with pytest.raises(InputTooLarge):
        D.parse("$default:a|b\n#a\n1", DecodeConfig(max_dictionary_entries=1))
    with pytest.raises(RangeOverflow):
        D.parse("#a\n1>50", DecodeConfig(max_range_expansion=9))
    many = spark.createDataFrame([(0, "#a\nx*50")], "chunk long, document string")
    with pytest.raises(Exception, match="too many values"):
        codec.expand_documents(many, config=DecodeConfig(max_range_expansion=9)).collect()


# ------------------------------------------------ rows and runs over block edges
def test_neighbours_over_blocks(spark):
    t = column(spark, list("aabbbcddddd"))
    got = with_previous(t, [], "v", "p", block=2).orderBy("rid").collect()
    assert [r["p"] for r in got] == [None, *"aabbbcdddd"]
    assert sorted(tuple(r) for r in find_runs(t, 2).collect()) == [(0, "a", 2), (2, "b", 3), (6, "d", 5)]
    assert longest_run(column(spark, list("aabb"))).first()["run_start"] == 2
    assert rle_encode(column(spark, ["5"] * 5 + ["6", "6", "7", None])).first()["encoded"] == "5*5 6 6 7 - "
    n = spark.createDataFrame([(i, x) for i, x in enumerate([1, 2, 3, 5, 7, 7])], "rid long, v long")
    assert sorted(tuple(r) for r in arithmetic_segments(n).collect()) == [(0, 3, 1), (2, 3, 2), (4, 2, 0)]
    assert [tuple(r) for r in arithmetic_segments(n.where("rid = 0")).collect()] == [(0, 1, 0)]


def test_ranks_and_missing_order(spark):
    t = spark.range(1000).select(((F.col("id") * 7919) % 1000).alias("x")).repartition(5)
    assert global_rank(t, ["x"]).where("rid <> x").count() == 0
    with pytest.raises(ValueError):
        with_rid(t)


# ------------------------------------------------ files, log lines, streams, command line
def test_csv_and_json_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,name,note\n1,"a, ""b""",x\n2,,"two\nlines"\n')
    t = T.read_csv(spark, str(tmp_path / "a.csv"))
    assert [tuple(r) for r in t.orderBy("rid").collect()] == [("1", 'a, "b"', "x", 0), ("2", None, "two\nlines", 1)]
    (tmp_path / "bad.csv").write_text("a,b\n1,2\n3\n")
    with pytest.raises(Exception):  # noqa: B017
        T.read_csv(spark, str(tmp_path / "bad.csv")).collect()
    (tmp_path / "a.json").write_text('[{"id": 1, "u": {"n": "x", "e": {}}}, {"id": 2.5, "t": [1, 2]}]')
    got = {(r["rid"], r["col_name"]): (r["kind"], r["v"]) for r in T.read_json(spark, str(tmp_path / "a.json")).collect()}
    assert got == {(0, "id"): ("integer", "1"), (0, "u.n"): ("string", "x"), (0, "t"): ("null", "\\0"), (1, "id"): ("float", "2.5"), (1, "u.n"): ("null", "\\0"), (1, "t"): ("string", "[1,2]")}
    for bad in ('{"a": 1}', "[1, 2]"):
        (tmp_path / "b.json").write_text(bad)
        with pytest.raises(Exception, match="array|object"):
            T.read_json(spark, str(tmp_path / "b.json")).collect()
    assert T.json_array(spark.createDataFrame([(0, 1, "x")], "rid long, `a.b` int, `a.c` string")) == '[{"a":{"b":1,"c":"x"}}]'


def test_log_lines(spark):
    lines = ["Jun 14 15:16:01 combo sshd(pam_unix)[19939]: authentication failure; logname= uid=0 euid=0 tty=NODEVssh ruser= rhost=218.188.2.4 ", "Jul  1 04:00:00 combo su(pam_unix)[21416]: session opened for user cyrus by (uid=0)", "Jul 1 04:00:00 combo cups: cupsd shutdown succeeded", "nonsense", "  "]
    t = column(spark, lines, "line")
    got = L.parse(t).orderBy("rid").collect()
    assert [(r["service"], r["pid"], r["msg_type"], r["rhost"], r["user"]) for r in got] == [("sshd(pam_unix)", 19939, "auth_fail", "218.188.2.4", None), ("su(pam_unix)", 21416, "sess_open", None, "cyrus"), ("cups", None, "svc_status", None, None), (None, None, "parse_error", None, None)]
    m = L.compact_ids(t).orderBy("rid").first()
    assert (m["mon"], m["day"], m["hour"], m["minute"], m["second"], m["code"], m["var1"], m["var2"]) == (5, 14, 15, 16, 1, "A", 0, 0)
    doc = L.codec(t.withColumn("chunk", F.lit(0))).first()["document"]
    assert doc.startswith("!L1\n$S:sshd(pam_unix)|su(pam_unix)|cups\n$I:218.188.2.4\n") and "@m:5 6 6 \n" in doc and "@p:19939 21416 - \n" in doc


def test_streams(spark, tmp_path):
    from colpattern.streaming import chunks

    src = tmp_path / "in"
    for k in range(3):
        spark.range(k * 10, k * 10 + 5).select("id", (F.col("id") * 10).alias("v")).coalesce(1).write.mode("append").parquet(str(src))
    stream = spark.readStream.schema("id long, v long").option("maxFilesPerTrigger", 1).parquet(str(src))
    chunks.write_stream(stream, str(tmp_path / "out"), str(tmp_path / "cp"), ["id"], chunk_rows=4).awaitTermination()
    back = codec.decompress(chunks.read_documents(spark, str(tmp_path / "out")))
    assert sorted(r["id"] for r in back.collect()) == [*range(5), *range(10, 15), *range(20, 25)]
    D.register(spark)
    (tmp_path / "docs").mkdir()
    for k in range(2):
        (tmp_path / "docs" / f"{k}.colp").write_text(f"!v1\n#a #b\n{k}>{k + 2}|x*3")
    assert sorted(r["a"] for r in spark.read.format("colpattern").load(str(tmp_path / "docs")).collect()) == ["0", "1", "1", "2", "2", "3"]
    q = chunks.read_rows(spark, str(tmp_path / "docs")).writeStream.format("memory").queryName("rows_in").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("rows_in").count() == 6


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "a.csv").write_text("id,status\n" + "".join(f"{i},active\n" for i in range(1, 11)))
    assert cli.main(["compress", "-i", str(tmp_path / "a.csv"), "-o", str(tmp_path / "a.colp"), "-v"]) == 0
    assert (tmp_path / "a.colp").read_text() == "!v1\n$default:active\n#id #status\n1>10|active*10"
    cli.main(["decompress", "-i", str(tmp_path / "a.colp"), "-o", str(tmp_path / "b.csv")])
    assert (tmp_path / "b.csv").read_text() == (tmp_path / "a.csv").read_text()
    cli.main(["info", "-i", str(tmp_path / "a.colp")])
    assert "column status" in capsys.readouterr().out


def test_escapes_come_back(spark):
    rng = random.Random(1)
    texts = ["".join(rng.choice(">*~|_#$:\\ \n\t\rab é日()") for _ in range(rng.randrange(0, 30))) for _ in range(500)] + ["x\\" * 20_000]
    t = column(spark, texts)
    assert t.where(X.unescape(X.escape(F.col("v"))) != F.col("v")).count() == 0
    bad = column(spark, ["hello\\x", "hello\\", "\\\\\\"])
    assert [r[0] is None for r in bad.orderBy("rid").select(X.unescape(F.col("v"))).collect()] == [True] * 3
