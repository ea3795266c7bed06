"""Records: exact round trip, known checksums, shuffled reads."""

import numpy as np
import pytest

from colpattern.llm import records, tokens


def test_known_checksums():
    for data, want in ((b"123456789", 0xE3069283), (b"", 0), (b"a", 0xC1D04330), (bytes(32), 0x8A9136AA)):
        a = np.frombuffer(data, np.uint8)
        assert records.crc32c(a, np.array([0]), np.array([len(a)]))[0] == want


def test_checksums_of_many_lengths():
    def slow(data):
        c, t = 0xFFFFFFFF, records._tables()[0]
        for b in data:
            c = int(t[(c ^ b) & 0xFF]) ^ (c >> 8)
        return c ^ 0xFFFFFFFF

    rng = np.random.default_rng(0)
    data = rng.integers(0, 256, 9000, dtype=np.uint8)
    ends = np.cumsum([0, 3, 4, 5, 255, 256, 257, 512, 1000, 0, 5000, 8])
    got = records.crc32c(data, ends[:-1], ends[1:])
    assert got.tolist() == [slow(data[a:b].tolist()) for a, b in zip(ends[:-1], ends[1:], strict=True)]


def test_round_trip(spark, docs, odd, tmp_path):
    at = f"file://{tmp_path}/out"
    rows = records.write(docs(odd).repartition(3), at, rows=2).collect()
    assert len(rows) == len(odd)
    back = records.read(spark, at).collect()
    mark = tokens.end_of_text()
    want = sorted(((i is None, i or 0), [*tokens.encode(t).tolist(), mark]) for i, t, *_ in odd)
    assert sorted(((r["doc_id"] is None, r["doc_id"] or 0), r["ids"]) for r in back) == want
    text = tokens.encoding().decode(next(r["ids"][:-1] for r in back if r["doc_id"] == 5))
    assert text == odd[5][1]


def test_shuffled_reads_and_index(spark, docs, tmp_path):
    at = f"file://{tmp_path}/out"
    written = {(r["shard"], r["record"]): r for r in records.write(docs([(i, f"text number {i}") for i in range(60)]).repartition(3), at).collect()}
    for r in records.index(spark, at).collect():
        assert (r["offset"], r["length"], r["doc_id"], r["n_tokens"]) == tuple(written[r["shard"], r["record"]][c] for c in ("offset", "length", "doc_id", "n_tokens"))
    one, two, again = ([r["doc_id"] for r in records.read(spark, at, seed, 2).collect()] for seed in (1, 2, 1))
    assert one == again and one != two and sorted(one) == sorted(two) == list(range(60))


def test_damage_is_found(spark, docs, tmp_path):
    records.write(docs([(1, "some text")]).coalesce(1), f"file://{tmp_path}/out").collect()
    file = next((tmp_path / "out").glob("*.rec"))
    good = file.read_bytes()
    assert records.deserialise(records.unframe(good))[0] == 1
    for k in range(len(good)):
        bad = bytearray(good)
        bad[k] ^= 1
        with pytest.raises(ValueError):
            records.unframe(bytes(bad))


def test_sets_are_written_once_and_whole(spark, docs, tmp_path):
    at = f"file://{tmp_path}/out"
    got = records.write(docs([(i, f"text number {i}") for i in range(40)]).repartition(4), at)
    times = {f.name: f.stat().st_mtime_ns for f in (tmp_path / "out").iterdir()}
    assert len(got.limit(3).collect()) == 3 and got.count() == 40
    assert times == {f.name: f.stat().st_mtime_ns for f in (tmp_path / "out").iterdir()}
    shard = next((tmp_path / "out").glob("*.rec"))
    whole = shard.read_bytes()
    shard.write_bytes(whole[:-1])
    with pytest.raises(ValueError):
        records.read(spark, at)
    shard.write_bytes(whole)
    assert records.read(spark, at).count() == 40
    (tmp_path / "out" / records.MANIFEST).unlink()
    with pytest.raises(ValueError):
        records.index(spark, at)


def test_nothing_to_write(spark, docs, tmp_path):
    at = f"file://{tmp_path}/none"
    assert records.write(docs([]), at).count() == 0
    assert records.read(spark, at).count() == 0
