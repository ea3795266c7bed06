"""One query per operator, with production parameters, over the whole of its table.

`ORACLE` holds DuckDB SQL where SQL can express the operator; the others are tested against
brute force, round trips and held-out accuracy in tests/llm.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colpattern.llm import ann, curriculum, jpeg, langid, omh, packing, records, substring, urls, weak
from colpattern.llm.common import fresh_path, modest_batches


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    modest_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes all documents as records to a folder of the shared storage; returns their offset index."""
    return records.write(_table(spark, sf_dir, "documents"), fresh_path(spark, "records"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.spans(_table(spark, sf_dir, "documents"))


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return omh.groups(_table(spark, sf_dir, "documents"))


def op4_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The queries are the rows whose id is divisible by 20; each is held against all rows."""
    return ann.neighbours(_table(spark, sf_dir, "embeddings"), ask=F.col("vec_id") % 20 == 0)


def op5_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables hold no images: each page's HTML, whole, is made one first."""
    return jpeg.media_columns(jpeg.page_images(_table(spark, sf_dir, "pages")))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weak.score(_table(spark, sf_dir, "documents"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def op8_curriculum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curriculum.schedule(_table(spark, sf_dir, "documents"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(_table(spark, sf_dir, "pages"))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_token_records, op2_substring_dedup, op3_near_dedup, op4_nearest_neighbours, op5_media_columns, op6_quality, op7_packing, op8_curriculum, op9_url_filter, op10_language, pipeline)
}

_TEMPER = dict(zip(curriculum.GRID, curriculum.TEMPER, strict=True))


def _curriculum_sql() -> str:
    """Windows over whole sources and the closed form of the inverse, segment by segment."""
    g, p = curriculum.GRID, curriculum.TEMPER
    n = len(g)
    raw = ", ".join(f"power(supply / total_supply, {p[k]}) AS r{k}" for k in range(n))
    norm = ", ".join(f"r{k} / sum(r{k}) OVER () AS w{k}" for k in range(n))
    cum = ["0.0"]
    for k in range(n - 1):
        cum.append(f"{cum[-1]} + (w{k} + w{k + 1}) * {(g[k + 1] - g[k]) / 2}")
    cums = ", ".join(f"{c} AS c{k}" for k, c in enumerate(cum))
    cases = []
    for k in range(n - 1):
        step = g[k + 1] - g[k]
        rest = f"greatest(area - c{k}, 0)"
        root = f"sqrt(greatest(w{k} * w{k} + 2 * ((w{k + 1} - w{k}) / {step}) * {rest}, 0))"
        cases.append(f"WHEN area < c{k + 1} THEN {g[k]} + least(CASE WHEN {rest} > 0 THEN 2 * {rest} / (w{k} + {root}) ELSE 0 END, {step})")
    return f"""
        WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x00-\\x20]+'))::BIGINT AS n_tokens,
                          md5(coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
        s AS (SELECT source, sum(n_tokens)::DOUBLE AS supply FROM d GROUP BY source),
        r AS (SELECT source, supply, {raw} FROM (SELECT *, sum(supply) OVER () AS total_supply FROM s)),
        w AS (SELECT source, supply, {norm} FROM r),
        c AS (SELECT *, {cums} FROM w),
        t AS (SELECT *, max(supply / c{n - 1}) OVER () AS total FROM c),
        b AS (SELECT doc_id, source, n_tokens, coalesce(sum(n_tokens) OVER (PARTITION BY source ORDER BY h, doc_id
                     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS before FROM d),
        e AS (SELECT b.doc_id, b.source, b.n_tokens, t.*, unnest(range(greatest(ceil((total * c{n - 1} - before) / supply - 1e-9), 1)::BIGINT)) AS epoch, before
              FROM b JOIN t ON b.source = t.source),
        a AS (SELECT *, (before + epoch * supply) / total AS area FROM e)
        SELECT doc_id, source, epoch, n_tokens, round(CASE {" ".join(cases)} ELSE {g[-1]} END, 6) AS position FROM a"""


ORACLE: dict[str, str] = {"op8_curriculum": _curriculum_sql(), "op9_url_filter": urls.judge_sql()}
