"""Exact deduplication by a tree merge of sorted digest runs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stemline.llm.common import checkpoint, drop_rows, meet, row_id, table

#: White space that counts as one space (fixed by the contract).
SPACE = r"[\x20\x09-\x0D]+"
#: Runs that one merge takes in.
FAN_IN = 16

#: Stands for a null id while runs are merged: behind all others.
NO_ID = (1 << 63) - 1

_RUN = "digest binary, bytes bigint, probe bigint, keep_id bigint, members bigint, run int"
_KEY = ["digest", "bytes", "probe"]


def normalised(text_col: str = "text") -> Column:
    return F.regexp_replace(F.coalesce(F.col(text_col).cast("string"), F.lit("")), SPACE, " ")


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id with the SHA-256 of the normalised text, its length and a second hash that verifies equality."""
    norm = normalised(text_col)
    return (
        docs.select(F.col(id_col).cast("bigint").alias("doc_id"), norm.alias("norm"))
        .select("doc_id", F.unhex(F.sha2("norm", 256)).alias("digest"), F.octet_length("norm").cast("bigint").alias("bytes"), F.xxhash64("norm").alias("probe"))
    )


def _collapse(parts: Iterator[pa.Table]) -> Iterator[pa.RecordBatch]:
    """One row for each key of key-sorted parts; the last key is carried, since it may go on in the next part."""
    held = None
    for part in parts:
        if held is not None:
            part = pa.concat_tables([held.select(part.column_names), part])
        n = part.num_rows
        if not n:
            continue
        new = np.ones(n, bool)
        if n > 1:
            same = None
            for k in _KEY:
                eq = pc.equal(part[k].slice(1), part[k].slice(0, n - 1))
                same = eq if same is None else pc.and_(same, eq)
            new[1:] = ~np.asarray(same.combine_chunks() if isinstance(same, pa.ChunkedArray) else same)
        at = np.flatnonzero(new)
        out = part.take(pa.array(at)).select([*_KEY, "run"])
        out = out.append_column("keep_id", pa.array(np.minimum.reduceat(part["keep_id"].to_numpy(), at)))
        out = out.append_column("members", pa.array(np.add.reduceat(part["members"].to_numpy(), at)))
        held, out = out.slice(len(at) - 1), out.slice(0, len(at) - 1)
        yield from out.select([*_KEY, "keep_id", "members", "run"]).to_batches()
    if held is not None:
        yield from held.select([*_KEY, "keep_id", "members", "run"]).to_batches()


def _first_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of one partition as one sorted run, a row for each digest: digests only, about 1/60 of the text."""
    got = [b for b in batches if b.num_rows]
    if got:
        rows = pa.Table.from_batches(got)
        rows = rows.sort_by([(k, "ascending") for k in _KEY])
        yield from _collapse(iter([rows]))


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield from _collapse((pa.Table.from_batches([b]) for b in batches))


def merge_runs(rows: DataFrame, fan_in: int = FAN_IN) -> DataFrame:
    """(digest, bytes, probe, keep_id, members) over all rows of digests().

    Each input partition becomes one sorted run, collapsed to a row a digest.
    In every round, runs whose numbers agree but for their lowest digit to the
    base fan_in meet, digest range by digest range: Spark's sort interleaves
    them (spilling where need be), and a streaming merge keeps the smallest id and the
    count of each verified digest. After as many rounds as the run number has
    digits one run is left, spread over all ranges. A digest that a third of all rows share
    arrives at most once from each run.
    """
    level = checkpoint(
        rows.select(*_KEY, F.coalesce("doc_id", F.lit(NO_ID)).alias("keep_id"), F.lit(1).cast("bigint").alias("members"), F.spark_partition_id().alias("run"))
        .mapInArrow(_first_runs, _RUN)
    )
    last = level.agg(F.max("run")).first()[0] or 0
    while last:
        last //= fan_in
        level = (
            level.withColumn("run", F.expr(f"cast(run div {fan_in} as int)"))
            .repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "digest", "run")
            .sortWithinPartitions("run", *_KEY)
            .mapInArrow(_merge, _RUN)
        )
    return level.drop("run").withColumn("keep_id", F.nullif("keep_id", F.lit(NO_ID)))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each document: the document it equals with the smallest id.

    Columns: doc_id, keep_id, group_size, kept, text_sha256. Null texts count as
    empty, so they equal each other and all-empty texts. A null id comes behind all others: keep_id is null, and such a row
    kept, only where no equal text has an id. Rows that repeat an id are each returned, and kept alike. Texts of any length are
    digested whole; other columns, whatever their names, are ignored; an empty table gives no rows.
    """
    rows = checkpoint(digests(docs, id_col, text_col))
    # texts that occur once keep themselves, so that only groups meet their rows
    groups = checkpoint(merge_runs(rows).where("members > 1").select(*[F.col(k).alias(f"g_{k}") for k in _KEY], "keep_id", "members"))
    met = meet(rows, groups, [(k, f"g_{k}") for k in _KEY]).withColumn("keep_id", F.when(F.col("members").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")))
    return met.select("doc_id", "keep_id", F.coalesce("members", F.lit(1)).cast("bigint").alias("group_size"), F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def distinct_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row for each distinct text: one with the smallest id. Rows go by id and text, so another text of the same id stays."""
    row = row_id(id_col, normalised(text_col))
    keyed = docs.select(row.alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    found = checkpoint(exact_dedup(keyed))
    pair = [F.col("doc_id").alias("row"), F.col("text_sha256").alias("digest")]
    again = found.where("kept and group_size > 1").groupBy(*pair).count().where("count > 1")
    return drop_rows(docs, row, F.sha2(normalised(text_col), 256), found.where("not kept").select(*pair), again)


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of equal whole texts of documents: see exact_dedup."""
    return exact_dedup(table(spark, sf_dir, "documents"))


SQL = r"""
with d as (
  select doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') as norm
  from documents)
select doc_id, min(doc_id) over w as keep_id, count(*) over w as group_size,
  doc_id is not distinct from min(doc_id) over w as kept, sha256(norm) as text_sha256
from d window w as (partition by norm)
"""
