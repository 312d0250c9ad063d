"""SimHash near-dedup: fingerprints that differ in few bits meet at the anchors of a covering code."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stemline.llm.common import checkpoint, meet, table
from stemline.llm.components import connected_components

#: Words in a shingle, XXH64 seed and differing bits of a link: fixed by the contract of the query.
WORDS, SEED, THRESHOLD = 4, 42, 4
#: Rows of an anchor above which the comparison goes by bands.
DENSE = 20_000


def fingerprint(text: str, words: int = WORDS) -> int:
    """64-bit SimHash of the word shingles of a text, repeats counted; 0 without words."""
    from xxhash import xxh64_intdigest

    tokens = text.encode().lower().split()
    if not tokens:
        return 0
    if len(tokens) <= words:
        hashes = np.array([xxh64_intdigest(b" ".join(tokens), SEED)], np.uint64)
    else:
        joined = b" ".join(tokens)
        size = np.fromiter(map(len, tokens), np.int64, len(tokens))
        end = np.cumsum(size + 1) - 1
        begin = (end - size)[: len(tokens) - words + 1].tolist()
        hashes = np.array([xxh64_intdigest(joined[a:b], SEED) for a, b in zip(begin, end[words - 1 :].tolist())], np.uint64)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[at : at + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """(doc_id, fp bigint): the fingerprint's bits as a signed integer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.fromiter((fingerprint(t.as_py() or "", words) for t in batch["text"]), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id bigint, fp bigint")


# ---- the covering code

def hamming_home(r: int) -> np.ndarray:
    """For each word of 2^r - 1 bits the code word of the perfect Hamming code at distance 1 or less."""
    n = (1 << r) - 1
    word = np.arange(1 << n, dtype=np.int64)
    syndrome = np.zeros_like(word)
    for bit in range(n):
        syndrome ^= np.where(word >> bit & 1, bit + 1, 0)
    return word ^ np.where(syndrome, np.int64(1) << np.maximum(syndrome - 1, 0), 0)


def anchors_of_part(r: int, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """For each word of 2^r - 1 bits: the code words within 1 + reach of it, its home first; and how many (padded with -1)."""
    n = (1 << r) - 1
    home = hamming_home(r)
    word = np.arange(1 << n, dtype=np.int64)
    found = [home]
    if reach:
        # a code word within 2 of the word is the home of a word that differs from it in one bit
        found += [home[word ^ (np.int64(1) << bit)] for bit in range(n)]
    table_ = np.stack(found, axis=1)
    rest = np.sort(table_[:, 1:], axis=1)
    dup = np.zeros_like(rest, bool)
    dup[:, 1:] = rest[:, 1:] == rest[:, :-1]
    rest[dup | (rest == home[:, None])] = -1
    rest = -np.sort(-rest, axis=1)  # the padding last
    keep = max(1, int((rest >= 0).sum(axis=1).max())) if reach else 0
    return np.concatenate([home[:, None], rest[:, :keep]], axis=1), (rest >= 0).sum(axis=1) + 1


#: The fingerprint's blocks: (first bit, parts), a part being ("code", r) for a Hamming code over
#: 2^r - 1 bits, or ("free", bits), where each word is its own anchor.
#: Of 4 differing bits at most one falls in some one of the three blocks.
BLOCKS = (
    (0, (("code", 4), ("code", 3))),
    (22, (("code", 4), ("code", 3))),
    (44, (("code", 4), ("free", 5))),
)


class Cover:
    """Anchors of fingerprints: on each block the product of its parts' codes.

    The covering radius is one bit a coded part. Two fingerprints with at most
    one differing bit in the block: the home anchor of one lies within radius plus
    one of the other, and only one part can hold that bit; so each fingerprint goes to its home
    anchor, and to those that differ from it in one part and lie within reach there.
    """

    def __init__(self) -> None:
        self.parts = {r: anchors_of_part(r, 1)[0] for r in (3, 4)}

    def replicate(self, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(anchor, fp, home): a row for each anchor of each fingerprint (uint64)."""
        anchor, of, home = [], [], []
        for number, (first, parts) in enumerate(BLOCKS):
            at, own, choices = first, [], []
            for kind, r in parts:
                bits = (1 << r) - 1 if kind == "code" else r
                word = (fp >> np.uint64(at) & np.uint64((1 << bits) - 1)).astype(np.int64)
                near = self.parts[r][word] if kind == "code" else np.concatenate([word[:, None], word[:, None] ^ (1 << np.arange(bits))], axis=1)
                own.append((near[:, 0], at - first))
                choices.append((near[:, 1:], at - first))
                at += bits
            base = sum(h << s for h, s in own) | np.int64(number) << 32
            anchor.append(base)
            of.append(fp)
            home.append(np.ones(len(fp), bool))
            for (near, shift), (h, _) in zip(choices, own):
                i, j = np.nonzero(near >= 0)
                anchor.append(base[i] ^ (h[i] ^ near[i, j]) << shift)
                of.append(fp[i])
                home.append(np.zeros(len(i), bool))
        return np.concatenate(anchor), np.concatenate(of), np.concatenate(home)


# ---- comparison at an anchor

class Forest:
    """Union-find over positions."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.root(i), self.root(j)
        self.up[max(i, j)] = min(i, j)
        return i != j


def link(fps: np.ndarray, threshold: int = THRESHOLD) -> list[tuple[int, int]]:
    """Pairs of positions of distinct fingerprints that join what is linked; a spanning forest, never all pairs."""
    n, out = len(fps), []
    if n < 2:
        return out
    forest = Forest(n)
    if n > DENSE:
        # threshold + 1 bands: linked fingerprints agree on one of them
        edges = np.linspace(0, 64, threshold + 2).astype(int)
        for lo, hi in zip(edges[:-1], edges[1:]):
            band = fps >> np.uint64(lo) & np.uint64((1 << int(hi - lo)) - 1)
            order = np.argsort(band, kind="stable")
            cut = np.flatnonzero(np.diff(band[order])) + 1
            for run in np.split(order, cut):
                _spread(fps, run, threshold, forest, out)
    else:
        _spread(fps, np.arange(n), threshold, forest, out)
    return out


def _spread(fps: np.ndarray, run: np.ndarray, threshold: int, forest: Forest, out: list) -> None:
    """Breadth-first through what is linked in run: n distances for each position, memory for n."""
    left = run
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            i = queue.pop()
            near = np.bitwise_count(fps[left] ^ fps[i]) <= threshold
            if near.any():
                hit, left = left[near], left[~near]
                for j in hit.tolist():
                    if forest.join(int(i), j):
                        out.append((int(i), j))
                queue += hit.tolist()


def _compare(batches: Iterator[pa.RecordBatch], threshold: int) -> Iterator[pa.RecordBatch]:
    """Links of a partition sorted by anchor; the last anchor of a batch goes on in the next."""
    held = (np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, bool))

    def links(anchor: np.ndarray, fp: np.ndarray, home: np.ndarray) -> pa.RecordBatch:
        a, b = [], []
        cut = np.flatnonzero(np.diff(anchor)) + 1
        first, past = np.r_[0, cut].tolist(), np.r_[cut, len(anchor)].tolist()
        for i, j in zip(first, past):
            own = fp[i:j][home[i:j]]
            if j - i < 2 or not len(own):
                continue
            here = fp[i:j]
            if len(own) * (j - i) <= 1 << 20:
                # a home's distance to itself is 0; anything else within the threshold is a link
                near = np.bitwise_count(own[:, None] ^ here[None, :]) <= threshold
                if int(near.sum()) == len(own):
                    continue
                here = here[near.any(axis=0)]
            for x, y in link(here, threshold):
                a.append(here[x])
                b.append(here[y])
        a, b = np.array(a, np.uint64).view(np.int64), np.array(b, np.uint64).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    for batch in batches:
        rows = [batch["anchor"].to_numpy(), batch["fp"].to_numpy().view(np.uint64), batch["home"].to_numpy(zero_copy_only=False)]
        rows = [np.concatenate([x, y]) for x, y in zip(held, rows)]
        if not len(rows[0]):
            continue
        whole = int(np.searchsorted(rows[0], rows[0][-1]))
        held = tuple(x[whole:] for x in rows)
        if whole:
            yield links(*(x[:whole] for x in rows))
    if len(held[0]):
        yield links(*held)


def link_fingerprints(unique: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """(a, b): links that join all fingerprints of unique(fp) at most threshold bits apart. threshold may be 0 to 5."""
    if not 0 <= threshold <= 5:
        raise ValueError("three blocks hold one of at most 5 differing bits alone")
    spark = unique.sparkSession

    def replicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cover = Cover()
        for batch in batches:
            anchor, fp, home = cover.replicate(batch["fp"].to_numpy().view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(fp.view(np.int64)), pa.array(home)], names=["anchor", "fp", "home"])

    at_anchor = unique.select("fp").mapInArrow(replicate, "anchor bigint, fp bigint, home boolean")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    met = at_anchor.repartition(parts, "anchor").sortWithinPartitions("anchor")
    return met.mapInArrow(lambda batches: _compare(batches, threshold), "a bigint, b bigint")


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, threshold: int = THRESHOLD) -> DataFrame:
    """(doc_id, fingerprint, component_id) for each document: the smallest doc_id that links reach.

    Null and wordless texts have fingerprint 0, linked like any other. A row with a null id has its fingerprint, links with nothing and has
    no component; rows that repeat an id are each returned. Texts of any length are read whole; other columns, whatever
    their names, are ignored; an empty table gives no rows. Equal fingerprints are one class before anything is compared,
    so thousands of copies cost one comparison.
    """
    rows = checkpoint(fingerprints(docs, id_col, text_col, words))
    unique = checkpoint(rows.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id")))
    # a class goes by its smallest document, so that the smallest node of a component is its name
    links = link_fingerprints(unique, threshold)
    for side in "ab":
        links = links.join(unique.select(F.col("fp").alias(side), F.col("first_id").alias(f"id_{side}")), side)
    groups = connected_components(links, "id_a", "id_b")
    classes = unique.join(groups, F.col("first_id") == F.col("node"), "left").withColumn("component_id", F.coalesce("component", "first_id"))
    # a document alone in its component names it, so that only others meet their rows
    classes = checkpoint(classes.where("last_id <> component_id").select(F.col("fp").alias("class_fp"), "component_id"))
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return meet(rows, classes, [("fp", "class_fp")]).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), component.alias("component_id"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of the fingerprints of all whole texts of documents: see simhash_groups."""
    return simhash_groups(table(spark, sf_dir, "documents"))
