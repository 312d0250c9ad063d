"""Removal of repeated passages by blocks of sorted suffixes and the ranks of a difference-cover sample.

To find 50-byte strings that also start in an earlier document, suffixes have to be
told apart to a depth of 50 only. The cover sample holds the suffixes at positions p of a
document with p mod 21 in a difference cover, so that any two equal 50-byte strings, wherever they
start, hold a pair of sample suffixes at the same distance from their starts, not more than 20. Sorted
bucket by bucket (a bucket: suffixes whose first 30 bytes hash alike), the sample shows which
suffixes tie; ties are resolved by ranks of the 70 bytes around a sample suffix, which cover all
its 50-byte strings, and only where those differ by the single strings. No task holds more than one bucket or one chunk of text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stemline.llm.common import checkpoint, meet, placed, release, table

#: Length of a repeated string.
LENGTH = 50
#: A perfect difference cover: each distance modulo 21 is that of one pair. A longer period has fewer samples, but shorter
#: strings stand for them, and more of those tie by chance: of check_s, 31 would keep 19 % and leave 7.7 % of all strings to
#: be compared singly, 21 keeps 24 % and leaves 4.8 %.
PERIOD, COVER = 21, (3, 6, 7, 12, 14)
#: Bytes after a sample position that any string it stands for is sure to hold, and bytes before it that one may start.
GRAM, BACK = LENGTH - PERIOD + 1, PERIOD - 1
#: Bytes of text in a chunk, and bytes of sample hashes in a bucket, about.
CHUNK_BYTES, BUCKET_BYTES = 2 << 20, 16 << 20

_RNG = np.random.default_rng(0x5EED)
_BYTE, _SECOND = (_RNG.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1) for _ in range(2))
_MUL = 0x9E3779B97F4A7C15 | 1
_INV = pow(_MUL, -1, 1 << 64)
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("mul", ())) <= n:
        size = max(n + 1, CHUNK_BYTES + (1 << 18))
        for name, x in (("mul", _MUL), ("inv", _INV)):
            _POWERS[name] = np.multiply.accumulate(np.r_[np.uint64(1), np.full(size, x, np.uint64)])
    return _POWERS["mul"], _POWERS["inv"]


def _mix(h: np.ndarray) -> np.ndarray:
    """Spread a hash over all of its bits."""
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


class Chunk:
    """Documents end to end, with hashes of any of their substrings from one running sum."""

    def __init__(self, data: bytes, ids: np.ndarray, sizes: np.ndarray):
        self.data, self.ids, self.sizes = data, ids, sizes
        self.first = np.cumsum(sizes) - sizes
        x = np.frombuffer(data, np.uint8)
        self.mul, inv = _powers(len(x))
        self._sum = np.zeros(len(x) + 1, np.uint64)
        np.cumsum(_BYTE[x] * inv[: len(x)], out=self._sum[1:])
        longest = int(sizes.max(initial=0))
        pattern = np.flatnonzero(np.isin(np.arange(PERIOD), COVER))
        pattern = (np.arange(longest // PERIOD + 1)[:, None] * PERIOD + pattern).ravel()
        count = np.where(sizes >= LENGTH, np.searchsorted(pattern, sizes - GRAM, side="right"), 0)
        self.at = np.concatenate([f + pattern[:c] for f, c in zip(self.first.tolist(), count.tolist())] or [np.empty(0, np.int64)]).astype(np.int64)
        self.doc = np.repeat(np.arange(len(ids)), count)  # of each sample suffix
        self.gram = self.hash(self.at, self.at + GRAM)

    def hash(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mix((self._sum[end] - self._sum[begin]) * self.mul[begin])

    def second(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Another 64 bits of hash, by other numbers of the bytes."""
        x = np.frombuffer(self.data, np.uint8)
        total = np.zeros(len(x) + 1, np.uint64)
        np.cumsum(_SECOND[x] * _powers(len(x))[1][: len(x)], out=total[1:])
        return _mix((total[end] - total[begin]) * self.mul[begin])

    def around(self, some: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(begin, last start, end) of the strings that hold these sample suffixes."""
        doc = self.doc[some]
        end = self.first[doc] + self.sizes[doc]
        begin, last = np.maximum(self.first[doc], self.at[some] - BACK), np.minimum(self.at[some], end - LENGTH)
        return begin, last, last + LENGTH

    def context(self, some: np.ndarray) -> np.ndarray:
        begin, _, end = self.around(some)
        shape = (self.at[some] - begin).astype(np.uint64) << np.uint64(7) | (end - self.at[some]).astype(np.uint64)
        return _mix(self.hash(begin, end) ^ _mix(shape + np.uint64(1)) ^ self.gram[some])


def _first_of(keys: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(distinct keys sorted, place of each row's key, smallest id a key, largest id a key)."""
    order = np.argsort(keys, kind="stable")
    k = keys[order]
    new = np.r_[True, k[1:] != k[:-1]] if len(k) else np.empty(0, bool)
    cut = np.flatnonzero(new)
    inverse = np.empty(len(k), np.int64)
    inverse[order] = np.cumsum(new) - 1
    if not len(k):
        return k, inverse, ids[:0], ids[:0]
    return k[cut], inverse, np.minimum.reduceat(ids[order], cut), np.maximum.reduceat(ids[order], cut)


# ---- packing

_PACKED = "chunk bigint, ids binary, sizes binary, data binary"


def pack(docs: DataFrame) -> DataFrame:
    """Chunks of docs(doc_id, text, part): whole documents, up to CHUNK_BYTES together, compressed."""
    import zstandard

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press, made, held, size, part = zstandard.ZstdCompressor(level=1), 0, [], 0, 0

        def out() -> pa.RecordBatch:
            ids, texts = np.array([x for x, _ in held], "<i8"), [x for _, x in held]
            sizes = np.array([len(x) for x in texts], "<i8")
            return pa.RecordBatch.from_arrays([pa.array([part << 32 | made], pa.int64()), *(pa.array([x], pa.binary()) for x in (ids.tobytes(), sizes.tobytes(), press.compress(b"".join(texts))))], names=["chunk", "ids", "sizes", "data"])

        for batch in batches:
            part = batch["part"][0].as_py() if batch.num_rows else part
            for i, t in zip(batch["doc_id"].to_pylist(), batch["text"]):
                held.append((i, t.as_buffer().to_pybytes() if t.is_valid else b""))
                size += len(held[-1][1])
                if size >= CHUNK_BYTES:
                    yield out()
                    made, held, size = made + 1, [], 0
        if held:
            yield out()

    return docs.mapInArrow(run, _PACKED)


def _unpack(r: dict) -> Chunk:
    import zstandard

    return Chunk(zstandard.ZstdDecompressor().decompress(r["data"]) if r["data"] else b"", np.frombuffer(r["ids"], "<i8"), np.frombuffer(r["sizes"], "<i8"))


# ---- exchange of one answer for each key, bucket by bucket

def _squeeze(values: np.ndarray, ascending: bool = False) -> bytes:
    """Whole numbers as byte planes, ascending ones as differences: the high planes are all but empty and compress."""
    if ascending:
        values = np.diff(values, prepend=values.dtype.type(0))
    width = values.dtype.itemsize
    return values.view(np.uint8).reshape(-1, width).T.tobytes()


def _widen(data: bytes, kind: str, ascending: bool = False) -> np.ndarray:
    width = np.dtype(kind).itemsize
    values = np.frombuffer(data, np.uint8).reshape(width, -1).T.copy().view(kind).ravel()
    return np.cumsum(values, dtype=kind) if ascending else values


def _ask(chunk: int, keys: np.ndarray, bits: int, dump: Callable[[slice], bytes]) -> list[dict]:
    """A row for each bucket of sorted keys, by their highest bits."""
    cut = np.searchsorted(keys >> np.uint64(64 - bits), np.arange((1 << bits) + 1, dtype=np.uint64))
    return [{"bucket": b, "chunk": chunk, "data": dump(slice(i, j))} for b, (i, j) in enumerate(zip(cut[:-1].tolist(), cut[1:].tolist())) if i < j]


def _answers(asked: DataFrame, bits: int, solve: Callable[[list[bytes]], list[bytes]]) -> DataFrame:
    """(chunk, data): for each chunk the answers to what it asked, bucket after bucket.

    A task reads the questions of a bucket from all chunks, a row each; equal keys are
    one within a chunk, so what all documents hold is no hot key.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[int, bytes]]] = {}
        for batch in batches:
            for r in batch.to_pylist():
                held.setdefault(r["bucket"], []).append((r["chunk"], r["data"]))
        for bucket in sorted(held):
            rows = held.pop(bucket)
            got = solve([d for _, d in rows])
            yield pa.RecordBatch.from_arrays([pa.array([bucket] * len(rows), pa.int32()), pa.array([c for c, _ in rows], pa.int64()), pa.array(got, pa.binary())], names=["bucket", "chunk", "data"])

    got = asked.repartitionById(1 << bits, "bucket").mapInArrow(run, "bucket int, chunk bigint, data binary")
    joined = F.transform(F.array_sort(F.collect_list(F.struct("bucket", "data"))), lambda x: x["data"])
    return got.groupBy("chunk").agg(joined.alias("data"))


def _shared_grams(rows: list[bytes]) -> list[bytes]:
    """A bit for each key: do two chunks hold it?"""
    keys = [_widen(d, "<u4", True) for d in rows]
    both = np.sort(np.concatenate(keys))
    both = both[1:][both[1:] == both[:-1]]
    if not len(both):
        return [bytes(len(k)) for k in keys]
    return [(both[np.minimum(np.searchsorted(both, k), len(both) - 1)] == k).astype(np.uint8).tobytes() for k in keys]


#: Answers on a context (told apart by 64 bits and the 38 or more of its gram): an earlier document has it; none has, but another document has its gram in another context.
FULL, EDGE = 1, 2


def _rank_contexts(rows: list[bytes]) -> list[bytes]:
    n = [len(d) // 20 for d in rows]
    gram = np.concatenate([_widen(d[: 4 * k], "<u4", True) for d, k in zip(rows, n)])
    context = np.concatenate([_widen(d[4 * k : 12 * k], "<u8") for d, k in zip(rows, n)])
    ids = np.concatenate([_widen(d[12 * k :], "<i8") for d, k in zip(rows, n)])
    order = np.lexsort((ids, context, gram))
    g, c, d = gram[order], context[order], ids[order]
    head = np.r_[True, (c[1:] != c[:-1]) | (g[1:] != g[:-1])]
    least = d[np.flatnonzero(head)][np.cumsum(head) - 1]
    code = np.where(d > least, FULL, 0).astype(np.uint8)
    # of the first holders of the contexts of a gram: are there two?
    cut = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
    size = np.diff(np.r_[cut, len(g)])
    two = np.repeat(np.minimum.reduceat(least, cut) != np.maximum.reduceat(least, cut), size)
    code[(code == 0) & two] = EDGE
    out = np.empty_like(code)
    out[order] = code
    return [x.tobytes() for x in np.split(out, np.cumsum(n)[:-1])]


def _earlier_strings(rows: list[bytes]) -> list[bytes]:
    """A bit for each string: does an earlier document hold it? Strings are told apart by 128 bits."""
    n = [len(d) // 24 for d in rows]
    keys = np.concatenate([_widen(d[: 8 * k], "<u8", True) for d, k in zip(rows, n)])
    more = np.concatenate([_widen(d[8 * k : 16 * k], "<u8") for d, k in zip(rows, n)])
    ids = np.concatenate([_widen(d[16 * k :], "<i8") for d, k in zip(rows, n)])
    place, least = _classes_of(keys, more, ids)
    out = (ids > least[place]).astype(np.uint8)
    return [x.tobytes() for x in np.split(out, np.cumsum(n)[:-1])]


def _classes_of(keys: np.ndarray, more: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(class of each row, smallest id of each class): rows are of one class if both hashes are equal; classes go by the first one."""
    order = np.lexsort((more, keys))
    k, m = keys[order], more[order]
    new = np.ones(len(k), bool)
    new[1:] = (k[1:] != k[:-1]) | (m[1:] != m[:-1])
    place = np.empty(len(k), np.int64)
    place[order] = np.cumsum(new) - 1
    return place, np.minimum.reduceat(ids[order], np.flatnonzero(new)) if len(k) else ids


# ---- what a chunk asks, and what it makes of the answers

class Work:
    """The steps of one chunk; each can be taken again from the text and the answers so far."""

    def __init__(self, row: dict, bits: int):
        self.row, self.bits, self.text = row, bits, _unpack(row)
        keep = np.uint64(64 - bits - 32)
        self.keys, self.place, least, most = _first_of(self.text.gram >> keep, self.text.ids[self.text.doc])
        self.local = least != most

    def _answer(self, name: str) -> np.ndarray:
        return np.frombuffer(b"".join(self.row[name] or []), np.uint8)

    def ask_grams(self) -> list[dict]:
        top = self.keys << np.uint64(64 - self.bits - 32)
        return _ask(self.row["chunk"], top, self.bits, lambda s: _squeeze((self.keys[s] & np.uint64(0xFFFFFFFF)).astype("<u4"), True))

    def _contexts(self) -> None:
        t = self.text
        self.some = np.flatnonzero((self._answer("grams").astype(bool) | self.local)[self.place])
        context, gram = t.context(self.some), t.gram[self.some]
        order = np.lexsort((context, gram))
        new = np.r_[True, (np.diff(gram[order]) != 0) | (np.diff(context[order]) != 0)] if len(order) else np.empty(0, bool)
        cut = np.flatnonzero(new)
        self.of = np.empty(len(order), np.int64)
        self.of[order] = np.cumsum(new) - 1
        self.own = t.ids[t.doc[self.some]]
        self.least = np.minimum.reduceat(self.own[order], cut) if len(cut) else self.own
        self.pair = gram[order][cut], context[order][cut]

    def ask_contexts(self) -> list[dict]:
        self._contexts()
        gram, context = self.pair
        short = (gram >> np.uint64(32 - self.bits)).astype("<u4")  # 32 bits after the bucket's: what ties by chance is told apart later
        return _ask(self.row["chunk"], gram, self.bits, lambda s: _squeeze(short[s], True) + _squeeze(context[s]) + _squeeze(self.least[s]))

    def _strings(self) -> None:
        self._contexts()
        t, code = self.text, self._answer("contexts")[self.of]
        full = (code == FULL) | (self.own > self.least[self.of])
        begin, last, end = t.around(self.some)
        self.covered = np.zeros(len(t.data) + 1, np.int64)
        np.add.at(self.covered, begin[full], 1)
        np.add.at(self.covered, end[full], -1)
        edge = ~full & (code == EDGE)
        starts = np.zeros(len(t.data) + 1, np.int64)
        np.add.at(starts, begin[edge], 1)
        np.add.at(starts, last[edge] + 1, -1)
        self.start = np.flatnonzero(np.cumsum(starts))
        self.start_id = t.ids[np.searchsorted(t.first, self.start, side="right") - 1] if len(self.start) else t.ids[:0]
        # documents without bytes share their first place with the next one; none of them has strings
        keys, more = t.hash(self.start, self.start + LENGTH), t.second(self.start, self.start + LENGTH) if len(self.start) else np.empty(0, np.uint64)
        self.string, self.string_least = _classes_of(keys, more, self.start_id)
        first = np.empty(len(self.string_least), np.int64)
        first[self.string] = np.arange(len(self.string))
        self.strings, self.strings_more = keys[first], more[first]

    def ask_strings(self) -> list[dict]:
        self._strings()
        return _ask(self.row["chunk"], self.strings, self.bits, lambda s: _squeeze(self.strings[s], True) + _squeeze(self.strings_more[s]) + _squeeze(self.string_least[s]))

    def spans(self) -> Iterator[tuple[int, bytes, list[tuple[int, int]]]]:
        """(doc_id, text, removed spans) of each document."""
        self._strings()
        t = self.text
        gone = self._answer("strings").astype(bool)[self.string] | (self.start_id > self.string_least[self.string])
        np.add.at(self.covered, self.start[gone], 1)
        np.add.at(self.covered, self.start[gone] + LENGTH, -1)
        hit = np.cumsum(self.covered)[:-1] > 0
        for i, a, n in zip(t.ids.tolist(), t.first.tolist(), t.sizes.tolist()):
            turn = np.flatnonzero(np.diff(np.r_[False, hit[a : a + n], False].astype(np.int8)))
            yield i, t.data[a : a + n], list(zip(turn[::2].tolist(), turn[1::2].tolist()))


def _each(chunks: DataFrame, bits: int, step: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                if rows := getattr(Work(batch.slice(k, 1).to_pylist()[0], bits), step)():
                    yield pa.RecordBatch.from_arrays([pa.array([r["bucket"] for r in rows], pa.int32()), pa.array([r["chunk"] for r in rows], pa.int64()), pa.array([r["data"] for r in rows], pa.binary())], names=["bucket", "chunk", "data"])

    return chunks.mapInArrow(run, "bucket int, chunk bigint, data binary")


def _answered(chunks: DataFrame, name: str, answers: DataFrame) -> DataFrame:
    """chunks with the answers in a column; the chunks stay where they are."""
    kept = checkpoint(answers.select(F.col("chunk").alias("_of"), F.col("data").alias(name)))
    return chunks.join(kept, F.col("chunk") == F.col("_of"), "left").drop("_of")


def repeated_spans(docs: DataFrame) -> tuple[DataFrame, int]:
    """Chunks of docs(doc_id, text) with all answers, and the bits of a bucket."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    packed = pack(docs.select("doc_id", F.col("text").cast("binary").alias("text"), F.spark_partition_id().cast("bigint").alias("part")))
    chunks = placed(packed, parts, "chunk")
    total = chunks.agg(F.sum(F.octet_length("sizes") / 8), F.sum(F.octet_length("data"))).first()
    share = len(COVER) / PERIOD * 4 * 3  # bytes of hashes for a compressed byte of text, three bytes of text in it
    bits = max(6, int(np.ceil(np.log2(max(1.0, (total[1] or 0) * share / BUCKET_BYTES)))))
    for step, name, solve in (("ask_grams", "grams", _shared_grams), ("ask_contexts", "contexts", _rank_contexts), ("ask_strings", "strings", _earlier_strings)):
        chunks = _answered(chunks, name, _answers(_each(chunks, bits, step), bits, solve))
        release(spark)
    return chunks, bits


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept) for each document; kept holds the remaining bytes.

    Null texts count as empty. Texts of under 50 bytes lose nothing. A row with a
    null id is before and behind none: it loses nothing and costs nothing. Rows that repeat an id are one another's equals, not earlier ones. A text that an
    earlier document equals is removed at once, so that only one of any number of copies is compared. Texts of any length are
    read whole; other columns, whatever their names, are ignored; an empty table gives no rows.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    every = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text.alias("text")).withColumn("sha", F.sha2("text", 256))
    rows, unplaced = every.where("doc_id is not null"), every.where("doc_id is null")
    digest = checkpoint(rows.select("doc_id", "sha", F.octet_length("text").cast("bigint").alias("n_bytes")))
    # only texts of several ids meet their rows
    least = digest.groupBy("sha").agg(F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id")).where("first_id < last_id")
    least = checkpoint(least.select(F.col("sha").alias("of"), "first_id"))
    copies = checkpoint(meet(digest, least, [("sha", "of")]).where("doc_id > first_id").select("doc_id", "sha", "n_bytes"))
    drop = checkpoint(copies.select(F.col("doc_id").alias("_i"), F.col("sha").alias("_s")).distinct())
    firsts = meet(rows, drop, [("doc_id", "_i"), ("sha", "_s")], "left_anti")
    chunks, bits = repeated_spans(firsts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                out = []
                for i, text, spans in Work(batch.slice(k, 1).to_pylist()[0], bits).spans():
                    edge = [0, *(x for s in spans for x in s), len(text)]
                    kept = b"".join(text[a:b] for a, b in zip(edge[::2], edge[1::2]))
                    out.append({"doc_id": i, "n_bytes": len(text), "n_removed": len(text) - len(kept), "n_spans": len(spans), "kept_sha256": hashlib.sha256(kept).hexdigest(), "kept": kept})
                if out:
                    yield pa.RecordBatch.from_pylist(out)

    found = chunks.mapInArrow(run, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary")
    long = F.col("n_bytes") >= LENGTH
    gone = copies.where(long).select("doc_id", "n_bytes", F.col("n_bytes").alias("n_removed"), F.lit(1).cast("bigint").alias("n_spans"), F.sha2(F.lit("").cast("binary"), 256).alias("kept_sha256"), F.lit("").cast("binary").alias("kept"))
    short = meet(rows, drop, [("doc_id", "_i"), ("sha", "_s")], "left_semi").where(F.octet_length("text") < LENGTH).unionByName(unplaced)
    short = short.select("doc_id", F.octet_length("text").cast("bigint").alias("n_bytes"), F.lit(0).cast("bigint").alias("n_removed"), F.lit(0).cast("bigint").alias("n_spans"), F.col("sha").alias("kept_sha256"), F.col("text").cast("binary").alias("kept"))
    return found.unionByName(gone).unionByName(short)


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is removed of all whole texts of documents: see substring_dedup."""
    return substring_dedup(table(spark, sf_dir, "documents")).drop("kept")
