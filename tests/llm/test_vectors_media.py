"""Neighbours against brute force, thumbnails against the pictures they come from."""

import numpy as np
import pytest

from colpattern.llm import ann, jpeg

TABLE = "vec_id long, embedding array<float>, label int, cell int, bound double, v string"


def vectors(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 0, 1, 2.0, "v") for i, v in rows], TABLE)


def test_chi_square():
    assert ann.chi2_quantile(0.95, 8) == pytest.approx(15.5073, abs=1e-3)
    assert ann.chi2_quantile(0.5, 1) == pytest.approx(0.4549, abs=1e-3)


@pytest.mark.parametrize("cell_rows", [4096, 100])
def test_recall(spark, cell_rows):
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((12, 32)) * 2
    x = (centres[rng.integers(0, 12, 900)] + rng.standard_normal((900, 32)) * 0.4).astype(np.float32)
    got = ann.neighbours(vectors(spark, list(enumerate(x.tolist()))), k=8, cell_rows=cell_rows).collect()
    d = ((x[:, None].astype(float) - x[None]) ** 2).sum(2)
    np.fill_diagonal(d, np.inf)
    top = np.argsort(d, 1)[:, :8]
    found = {}
    for r in got:
        found.setdefault(r["vec_id"], {})[r["neighbour_id"]] = r["distance"]
        assert r["distance"] == pytest.approx(np.sqrt(d[r["vec_id"], r["neighbour_id"]]), abs=1e-4)
    assert all(len(found[i]) == 8 for i in range(900))
    assert np.mean([len(set(top[i]) & set(found[i])) / 8 for i in range(900)]) >= 0.95


def test_odd_vectors(spark):
    rows = [(1, [0, 0]), (2, [0, 0]), (3, [1, 0]), (4, None), (5, [1, 2, 3]), (6, [float("nan"), 0]), (7, [None, 1]), (None, [0, 1]), (3, [1, 0]), (8, [])]
    got = {(r["vec_id"], r["rank"]): (r["neighbour_id"], r["distance"]) for r in ann.neighbours(vectors(spark, rows), k=5).collect()}
    assert got == {(1, 1): (2, 0.0), (1, 2): (3, 1.0), (2, 1): (1, 0.0), (2, 2): (3, 1.0), (3, 1): (1, 1.0), (3, 2): (2, 1.0)}
    assert ann.neighbours(vectors(spark, [])).count() == 0
    assert ann.neighbours(vectors(spark, [(1, [1, 1])])).count() == 0


def test_many_equal_vectors(spark):
    got = ann.neighbours(vectors(spark, [(i, [1, 2, 3]) for i in range(300)]), k=3, cell_rows=50).collect()
    assert len(got) == 900 and {r["distance"] for r in got} == {0.0}


@pytest.mark.parametrize("broadcast", [100_000, 0])
def test_copies_and_queries_match_brute_force(spark, monkeypatch, broadcast):
    """A third of all rows are one vector, others repeat too; only some rows ask."""
    monkeypatch.setattr(ann, "CLASSES", broadcast)
    rng = np.random.default_rng(8)
    x = rng.integers(0, 9, (240, 3)).astype(np.float32)
    x[rng.permutation(240)[:80]] = x[0]
    ask = rng.random(240) < 0.4
    t = spark.createDataFrame([(i, v, bool(a), 1, "s") for i, (v, a) in enumerate(zip(x.tolist(), ask, strict=True))], "vec_id long, embedding array<float>, asks boolean, slice int, rep string")
    got = {}
    for r in ann.neighbours(t, k=6, p=1 - 1e-9, cell_rows=30, ask=t["asks"]).orderBy("vec_id", "rank").collect():
        got.setdefault(r["vec_id"], []).append((r["distance"], r["neighbour_id"]))
    d = np.sqrt(((x[:, None].astype(float) - x[None]) ** 2).sum(2)).round(6)
    want = {i: sorted((d[i, j], j) for j in range(240) if j != i)[:6] for i in range(240) if ask[i]}
    assert got == want


def test_boxes_descend_to_every_near_cell():
    rng = np.random.default_rng(2)
    mins = rng.random((16, 4))
    maxs = mins + rng.random((16, 4)) * 0.3
    q, reach = rng.random((50, 4)) * 2, rng.random(50)
    row, cell = ann.Boxes(mins, maxs).within(q, reach)
    assert set(zip(row.tolist(), cell.tolist(), strict=True)) == set(zip(*(x.tolist() for x in np.nonzero(ann.gaps(q, mins, maxs) <= reach[:, None])), strict=True))


# ------------------------------------------------ JPEG
def means(data):
    n = max(1, -(-len(data) // 64))
    across = int(np.ceil(np.sqrt(n)))
    cells = np.zeros((-(-n // across) * across, 64))
    cells.ravel()[: len(data)] = np.frombuffer(data, np.uint8)
    return np.rint(cells.mean(1)).reshape(-1, across)


@pytest.mark.parametrize("kind", range(15))
def test_thumbnail_is_the_picture(kind):
    """Grey, 4:2:0 and 4:4:4, with restarts and without."""
    data = bytes(np.random.default_rng(kind).integers(0, 256, 64 * (5 + 7 * kind) + kind, dtype=np.uint8))
    want = means(data)
    blob = jpeg.picture(data, kind)
    img = jpeg.parse(blob)
    thumb = jpeg.decode([img])[0]
    h, w = thumb.shape
    assert (h, w) == (-(-img.height // 8), -(-img.width // 8))
    assert np.abs(thumb.astype(int) - want[:h, :w]).max() <= 1
    row = jpeg.describe([blob])[0]
    assert row[:6] == ("ok", img.width, img.height, 1 if kind % 3 == 0 else 3, w, h)


@pytest.mark.parametrize(("grey", "quality", "noise"), [(True, 0.9, 60), (False, 0.3, 60), (False, 1.0, 127), (False, 0.75, 3)])
def test_images_of_another_encoder(spark, grey, quality, noise):
    """Pictures that the JVM's encoder writes, with all their coefficients, against its own decoding."""
    jvm = spark._jvm
    rng = np.random.default_rng(4)
    h, w = 75, 101
    base = 128 + 90 * np.sin(np.arange(w) / 17)[None, :] * np.cos(np.arange(h) / 11)[:, None]
    rgb = np.clip(base[:, :, None] * (1 if grey else np.array([1, 0.8, 0.5])) + rng.integers(-noise, noise + 1, (h, w, 1 if grey else 3)), 0, 255).astype(np.int64)
    rgb = np.broadcast_to(rgb, (h, w, 3))
    img = jvm.java.awt.image.BufferedImage(w, h, 10 if grey else 1)
    if grey:
        for y in range(h):
            for x in range(w):
                img.getRaster().setSample(x, y, 0, int(rgb[y, x, 0]))
    else:
        for y in range(h):
            for x in range(w):
                img.setRGB(x, y, int(rgb[y, x, 0] << 16 | rgb[y, x, 1] << 8 | rgb[y, x, 2]))
    out = jvm.java.io.ByteArrayOutputStream()
    writer = jvm.javax.imageio.ImageIO.getImageWritersByFormatName("jpg").next()
    param = writer.getDefaultWriteParam()
    param.setCompressionMode(2)
    param.setCompressionQuality(quality)
    stream = jvm.javax.imageio.ImageIO.createImageOutputStream(out)
    writer.setOutput(stream)
    writer.write(None, jvm.javax.imageio.IIOImage(img, None, None), param)
    stream.flush()
    data = bytes(out.toByteArray())
    luma = rgb[:, :, 0] if grey else rgb @ np.array([0.299, 0.587, 0.114])
    means = luma[: h // 8 * 8, : w // 8 * 8].reshape(h // 8, 8, w // 8, 8).mean((1, 3))
    parsed = jpeg.parse(data)
    thumb = jpeg.decode([parsed])[0]
    assert (parsed.width, parsed.height, len(parsed.components)) == (w, h, 1 if grey else 3) and thumb.shape == (-(-h // 8), -(-w // 8))
    assert np.abs(thumb[: h // 8, : w // 8] - means).max() <= (1.5 if quality >= 0.75 else 4)
    assert jpeg.describe([data, data])[1][:3] == ("ok", w, h)


def test_images_of_a_group_do_not_disturb_each_other():
    blobs = [jpeg.picture(bytes([k]) * (200 * k + 1), k) for k in range(40)]
    assert jpeg.describe(blobs) == [jpeg.describe([b])[0] for b in blobs]


def test_damaged_images():
    good = jpeg.picture(b"some page " * 100, 1)
    assert jpeg.describe([None, b"", b"GIF89a...", good[:-40], good[:30], good.replace(b"\xff\xc0", b"\xff\xc2")]) == [
        ("null",) + (None,) * 7, ("null",) + (None,) * 7, ("not_jpeg",) + (None,) * 7, jpeg.describe([good[:-40]])[0], ("corrupt",) + (None,) * 7, jpeg.describe([good.replace(b"\xff\xc0", b"\xff\xc2")])[0],
    ]
    assert jpeg.describe([good[:-40]])[0][0] == "corrupt"
    assert jpeg.describe([good.replace(b"\xff\xc0", b"\xff\xc2")])[0][0] == "unsupported"
    rng = np.random.default_rng(1)
    for _ in range(200):  # nothing that is done to the bytes may raise
        bad = bytearray(good)
        for k in rng.integers(0, len(bad), 5):
            bad[k] = rng.integers(0, 256)
        assert jpeg.describe([bytes(bad)])[0][0] in ("ok", "corrupt", "unsupported", "not_jpeg")


def test_media_columns(spark):
    pages = spark.createDataFrame([(1, "u", "<p>hello</p>" * 50, "z"), (2, "u", None, "z"), (None, "u", "x", "z"), (4, "u", "", "z"), (4, "u", "", "z"), (5, "u", "long " * 100_000, "z")], "page_id long, url string, html string, image string")
    got = sorted(((r["page_id"] or 0, r["status"]) for r in jpeg.media_columns(jpeg.page_images(pages)).collect()))
    assert got == [(0, "ok"), (1, "ok"), (2, "null"), (4, "ok"), (4, "ok"), (5, "ok")]
    assert jpeg.media_columns(jpeg.page_images(pages.limit(0))).count() == 0
