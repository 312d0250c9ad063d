"""Near copies by the exact Jaccard similarity of their word shingles.

Candidates meet in bands of MinHashes or by fingerprints that differ in few bits; what candidates join
goes to one task, texts and all, and there a pair is a link only if its shingle sets are similar enough.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stemline.llm.common import checkpoint, drop_rows, let_go, meet, row_id
from stemline.llm.components import connected_components
from stemline.llm.simhash import SEED, fingerprint, link_fingerprints

#: Least similarity, and words in a shingle.
SIMILARITY, WORDS = 0.8, 5
#: Bands of MinHashes and MinHashes in a band: of pairs with similarity 0.8 all but (1 - 0.8^6)^32 = 0.006 % meet in some band.
BANDS, ROWS = 32, 6
#: Bands whose groups are joined before the others are looked at.
FIRST_BANDS = 4
#: Differing bits of fingerprints up to which they are candidates as well.
BITS = 5
#: Shingles that are hashed side by side.
SIDE = 4096

_rng = np.random.default_rng(7)
_TURNS = _rng.integers(0, 1 << 32, (BANDS * ROWS, 1), dtype=np.uint32) | np.uint32(1)
_MIX = _rng.integers(0, 1 << 63, (BANDS, ROWS), dtype=np.uint64) | np.uint64(1)
_BAND = _rng.integers(0, 1 << 63, BANDS, dtype=np.uint64)


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct XXH64 hashes of the word shingles; a text of fewer words is one shingle, one without words has none."""
    from xxhash import xxh64_intdigest

    tokens = (text or "").encode().lower().split()
    if not tokens:
        return np.empty(0, np.uint64)
    found = {xxh64_intdigest(b" ".join(tokens[k : k + words]), SEED) for k in range(max(1, len(tokens) - words + 1))}
    return np.sort(np.fromiter(found, np.uint64, len(found)))


def bands(hashes: np.ndarray) -> np.ndarray:
    """A key for each band (int64): equal where all MinHashes of the band are."""
    low = np.full(BANDS * ROWS, 0xFFFFFFFF, np.uint32)
    slim = (hashes >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(slim), SIDE):
        np.minimum(low, (slim[None, at : at + SIDE] * _TURNS).min(axis=1), out=low)
    key = ((low.reshape(BANDS, ROWS).astype(np.uint64) + np.uint64(1)) * _MIX).sum(axis=1, dtype=np.uint64) ^ _BAND
    return ((key ^ key >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)).view(np.int64)


def class_of(hashes: np.ndarray) -> int:
    """Key of texts with the same shingles."""
    from xxhash import xxh64_intdigest

    return xxh64_intdigest(hashes.tobytes(), SEED) - (1 << 63)


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b): of a partition sorted by band and node, each node with the first of its band."""
    band, first = None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        key, node = batch["band"].to_numpy(), batch["node"].to_numpy()
        begin = np.r_[key[0] != band, key[1:] != key[:-1]]
        place = np.maximum.accumulate(np.where(begin, np.arange(len(key)), -1))
        to = np.where(place < 0, first, node[place]) if first is not None else node[place]
        band, first = key[-1], to[-1]
        other = to != node
        yield pa.RecordBatch.from_arrays([pa.array(to[other].astype(np.int64)), pa.array(node[other])], names=["a", "b"])


def _stars_of(banded: DataFrame, parts: int) -> DataFrame:
    """(a, b): links that join all nodes of each band of banded(band, node)."""
    return banded.repartition(parts, "band").sortWithinPartitions("band", "node").mapInArrow(_stars, "a bigint, b bigint").distinct()


def join_similar(sets: list[np.ndarray], similarity: float = SIMILARITY) -> list[int]:
    """For each set the first position that links reach; a link is a pair whose Jaccard similarity is large enough.

    Breadth-first: a set is held against all that nothing has reached yet, and only sizes that allow the similarity.
    """
    n = len(sets)
    name, size = list(range(n)), np.array([len(s) for s in sets], np.int64)
    place = np.unique(np.concatenate(sets), return_inverse=True)[1] if n else np.empty(0, np.int64)
    places = np.split(place, np.cumsum(size)[:-1]) if n else []
    here = np.zeros(int(place.max(initial=-1)) + 1, bool)
    left = np.arange(n)
    flat, begin = place, np.cumsum(size) - size
    while len(left) > 1:
        root, queue = int(left[0]), [int(left[0])]
        left, flat, begin = left[1:], flat[size[root] :], begin[1:] - size[root]
        while queue and len(left):
            i = queue.pop()
            least, most = np.minimum(size[left], size[i]), np.maximum(size[left], size[i])
            if not (least >= similarity * most - 1e-9).any():
                continue
            here[places[i]] = True
            both = np.add.reduceat(here[flat], begin, dtype=np.int64)
            here[places[i]] = False
            near = both >= similarity * (size[left] + size[i] - both) - 1e-9
            if near.any():
                hit = left[near]
                for j in hit.tolist():
                    name[j] = root
                queue += hit.tolist()
                flat = flat[np.repeat(~near, size[left])]
                left = left[~near]
                begin = np.cumsum(size[left]) - size[left]
    return name


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(class, group) of a partition of candidates, sorted by component and class; a group goes by one of its classes, single ones are left out."""
    let_go()
    component, ids, sets = None, [], []

    def found() -> pa.RecordBatch:
        name = join_similar(sets)
        many = np.bincount(name, minlength=len(name))
        at = [k for k, j in enumerate(name) if many[j] > 1]
        return pa.RecordBatch.from_arrays([pa.array([ids[k] for k in at], pa.int64()), pa.array([ids[name[k]] for k in at], pa.int64())], names=["class", "group"])

    for batch in batches:
        for g, c, t in zip(batch["component"].to_pylist(), batch["class"].to_pylist(), batch["text"]):
            if g != component:
                if len(ids) > 1:
                    yield found()
                component, ids, sets = g, [], []
            hashes = shingles(t.as_py())
            if len(hashes):
                ids.append(c)
                sets.append(hashes)
    if len(ids) > 1:
        yield found()


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row for each group of near copies: one with the smallest id that links reach.

    A link is a pair of texts whose shingle sets have a Jaccard similarity of SIMILARITY or more. Texts
    without words are copies of each other. A null id comes behind all others. Rows go by id and text, so
    another text of the same id stays, and of equal rows one does. Texts of any length are read whole; all columns
    are kept, and an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for batch in (whole.slice(k, 1000) for whole in batches for k in range(0, whole.num_rows, 1000)):
            texts = batch["text"].to_pylist()
            sets = [shingles(t) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [
                    batch["doc_id"], batch["digest"], pa.array([class_of(s) for s in sets], pa.int64()), pa.array([fingerprint(t or "", WORDS) for t in texts], pa.uint64()).view(pa.int64()),
                    pa.array([bands(s) if len(s) else None for s in sets], pa.list_(pa.int64())),
                ],
                names=["doc_id", "digest", "class", "fp", "bands"],
            )

    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    row, digest = row_id(id_col, text), F.xxhash64(text)
    slim = docs.select(row.alias("doc_id"), digest.alias("digest"), text.alias("text"))
    rows = checkpoint(slim.mapInArrow(run, "doc_id bigint, digest bigint, class bigint, fp bigint, bands array<bigint>"))
    first = F.min(F.struct("doc_id", "digest"))
    unique = checkpoint(rows.groupBy("class").agg(first.alias("first"), F.first("fp").alias("fp"), F.first("bands").alias("bands")))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # a few bands first, so that a large group is one node when the others are looked at
    wordy = unique.where("bands is not null")
    by_band = [wordy.select(F.explode(F.slice("bands", a + 1, b - a)).alias("band"), "class") for a, b in ((0, FIRST_BANDS), (FIRST_BANDS, BANDS))]
    early = _stars_of(by_band[0].select("band", F.col("class").alias("node")), parts)
    label = checkpoint(connected_components(early)).select(F.col("node").alias("of"), F.col("component").alias("label"))
    named = checkpoint(wordy.join(label, F.col("class") == F.col("of"), "left").select("class", "fp", F.coalesce("label", "class").alias("label"), F.slice("bands", FIRST_BANDS + 1, BANDS).alias("bands")))
    late = _stars_of(named.select(F.explode("bands").alias("band"), F.col("label").alias("node")).distinct(), parts)
    by_fp = checkpoint(named.groupBy("fp").agg(F.min("label").alias("node"), F.max("label").alias("last")))
    links = link_fingerprints(by_fp.select("fp"), BITS)
    for side in "ab":
        links = links.join(by_fp.select(F.col("fp").alias(side), F.col("node").alias(f"id_{side}")), side)
    same = named.join(by_fp.where("node < last"), "fp").where("label <> node").select(F.col("node").alias("a"), F.col("label").alias("b"))
    candidates = late.unionByName(same).unionByName(links.select(F.col("id_a").alias("a"), F.col("id_b").alias("b"))).where("a <> b")
    groups = checkpoint(connected_components(candidates.distinct()).select(F.col("node").alias("of"), "component"))
    groups = meet(named, groups, [("label", "of")]).select(F.col("class").alias("node"), F.coalesce("component", "label").alias("component"))
    many = checkpoint(groups.groupBy("component").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("component").alias("some")))
    groups = meet(groups, many, [("component", "some")], "left_semi")
    members = checkpoint(unique.join(groups, F.col("class") == F.col("node")).select("component", "class", F.col("first.doc_id").alias("i"), F.col("first.digest").alias("d")))
    texts = members.join(slim, (F.col("i") == F.col("doc_id")) & (F.col("d") == F.col("digest"))).select("component", "class", "text").dropDuplicates(["class"])
    verified = checkpoint(texts.repartition(parts, "component").sortWithinPartitions("component", "class").mapInArrow(_verified, "class bigint, group bigint"))
    # of a group the row with the smallest id stays; of the texts in none, each its own class's
    named = unique.select("class", "first").join(verified, "class", "left").select("class", "first", F.coalesce("group", "class").alias("group"))
    best = named.groupBy("group").agg(F.min("first").alias("best"))
    keeps = named.join(best.withColumnRenamed("group", "of"), F.col("group") == F.col("of")).select(F.col("class").alias("c"), F.col("best.doc_id").alias("b_id"), F.col("best.digest").alias("b_digest"))
    lone = rows.groupBy("class").agg(F.count(F.lit(1)).alias("n")).where("n = 1").select(F.col("class").alias("l"))
    judged = checkpoint(keeps.join(lone, F.col("c") == F.col("l"), "left").join(unique.select(F.col("class").alias("u"), "first"), F.col("c") == F.col("u")).where(
        "l is null or b_id <> first.doc_id or b_digest <> first.digest").select("c", "b_id", "b_digest"))
    found = meet(rows.select("doc_id", "digest", "class"), judged, [("class", "c")], "left").where("b_id is not null")
    found = checkpoint(found.select(F.col("doc_id").alias("row"), "digest", (F.col("doc_id").eqNullSafe(F.col("b_id")) & F.col("digest").eqNullSafe(F.col("b_digest"))).alias("kept")))
    again = found.where("kept").groupBy("row", "digest").count().where("count > 1")
    return drop_rows(docs, row, digest, found.where("not kept").select("row", "digest"), again)
