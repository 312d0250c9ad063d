"""Token ids as flat unsigned-integer files with 64-bit document offsets, to be memory-mapped.

A folder holds pairs of files: part-*.bin, the ids of its documents end to end as
little-endian unsigned 16-bit (vocabularies of up to 65,536 ids) or 32-bit integers; and part-*.idx,
little-endian signed 64-bit: the number n of documents, n doc_ids, and n + 1 offsets into the whole
corpus, so that document k of the part has ids offsets[k] - offsets[0] up to offsets[k + 1] - offsets[0] of the .bin. Parts hold
ascending ranges of doc_id. manifest/ lists them, in order, with their bases.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stemline.llm.bpe import Kept, byte_alphabet
from stemline.llm.common import held, shared_folder, table

#: Id that ends a document.
END_ID = 2

#: Blanks to Python's split() that are none to the tokenizers library.
_SEPARATORS = re.compile("[\x1c-\x1f]")


#: Latin letters, then at most one run of marks: two pieces at most, that normalising only turns to lower case.
_WORD = re.compile(r"([a-z\u00df-\u00f6\u00f8-\u024f]+)([.,;:!?]*)")


class WordEncoder:
    """Ids of texts by a vocabulary that drops white space and never joins across it: word by word, each word once.

    What stands between blanks is looked up as it is, then by its letters in lower case. New
    words of letters go to the library's model at once, everything else through the whole library.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.dtype = "<u2" if max(self.library.get_vocab().values()) < 1 << 16 else "<u4"
        self._letter = {b: c for c, b in byte_alphabet().items()}
        self._model = self.library.model
        self._pieces = Kept(self._piece)
        self._chunks = Kept(self._chunk)

    def _ids(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def _piece(self, piece: str) -> bytes:
        marked = piece if piece.isascii() else "".join([self._letter[b] for b in piece.encode()])
        return np.array([t.id for t in self._model.tokenize(marked)], self.dtype).tobytes()

    def _chunk(self, chunk: str) -> bytes:
        m = _WORD.fullmatch(chunk.lower())
        if m is None:
            return self._ids(chunk)
        return self._pieces[m[1]] + self._pieces[m[2]] if m[2] else self._pieces[m[1]]

    def encode(self, text: str) -> bytes:
        if _SEPARATORS.search(text):
            return self._ids(text)
        return b"".join(map(self._chunks.__getitem__, text.split()))


def _load(path: str) -> WordEncoder:
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return held(f"words and ids {path}", lambda: WordEncoder(path))


def _store(uri: str):
    """(pyarrow file system, path) of a folder that all executors see."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def write_token_files(docs: DataFrame, folder: str, vocabulary: str, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write docs to folder and return the manifest: part, path, first_id, docs, tokens, base, dtype.

    Null texts count as empty and hold the end alone; null ids stand behind all others, as NO_ID; documents
    that repeat an id stand side by side. Texts of any length are encoded whole; other columns, whatever their names, are ignored. No rows give no parts. A part is written
    under a name of its own attempt and counts once the manifest, gathered from the attempts that
    succeeded, names it: lost executors and second attempts leave no mixed files.
    """
    spark = docs.sparkSession
    slim = docs.select(F.coalesce(F.col(id_col).cast("bigint"), F.lit(NO_ID)).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = [int(x) for x in dict.fromkeys(slim.approxQuantile("doc_id", [k / parts for k in range(1, parts)], 0.2 / parts))] if parts > 1 else []

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, edges = _load(vocabulary), np.array(cuts, np.int64)
        end = np.array([end_id], coder.dtype).tobytes()
        for batch in batches:
            at = np.searchsorted(edges, batch["doc_id"].to_numpy(), side="left").astype(np.int32)
            ids = [coder.encode(t.as_py() or "") + end for t in batch["text"]]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(ids, pa.binary()), pa.array(at)], names=["doc_id", "ids", "part"])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, at = _store(folder)
        out, name, held = None, "", []
        for batch in batches:
            if not batch.num_rows:
                continue
            if out is None:
                name = f"part-{batch['part'][0].as_py():06d}-{uuid.uuid4().hex}"
                out = store.open_output_stream(f"{at}/{name}.bin")
            for x in batch["ids"]:
                out.write(x.as_buffer())
            held.append((batch["doc_id"].to_numpy(), np.array([len(x.as_buffer()) for x in batch["ids"]], np.int64), batch["part"][0].as_py()))
        if out is None:
            return
        out.close()
        width = np.dtype(_load(vocabulary).dtype).itemsize
        ids, sizes = np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held]) // width
        with store.open_output_stream(f"{at}/{name}.len") as f:
            f.write(np.concatenate([ids, sizes]).astype("<i8").tobytes())
        yield pa.RecordBatch.from_pylist([{"part": held[0][2], "name": name, "first_id": int(ids[0]), "docs": len(ids), "tokens": int(sizes.sum()), "dtype": _load(vocabulary).dtype}])

    store, at = _store(folder)
    store.create_dir(at, recursive=True)
    dealt = slim.mapInArrow(encode, "doc_id bigint, ids binary, part int").repartitionById(len(cuts) + 1, "part").sortWithinPartitions("doc_id")
    rows = sorted(dealt.mapInArrow(write, "part bigint, name string, first_id bigint, docs bigint, tokens bigint, dtype string").collect(), key=lambda r: r["part"])
    base, listed = 0, []
    for r in rows:  # one row a part: the prefix sums of their sizes are the parts' bases
        listed.append((r["part"], f"{folder}/{r['name']}", r["first_id"], r["docs"], r["tokens"], base, r["dtype"]))
        base += r["tokens"]
    manifest = spark.createDataFrame(listed, "part int, path string, first_id bigint, docs bigint, tokens bigint, base bigint, dtype string")

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                store, at = _store(r["path"])
                with store.open_input_file(f"{at}.len") as f:
                    both = np.frombuffer(f.read(), "<i8")
                n = r["docs"]
                with store.open_output_stream(f"{at}.idx") as f:
                    f.write(np.concatenate([[n], both[:n], [r["base"]], r["base"] + np.cumsum(both[n:])]).astype("<i8").tobytes())
            yield batch

    manifest = manifest.repartition(max(1, len(listed)), "part").mapInArrow(index, manifest.schema)
    manifest.coalesce(1).write.parquet(f"{folder}/manifest")
    return spark.read.parquet(f"{folder}/manifest")


#: Stands for a null id in the files.
NO_ID = (1 << 63) - 1


def open_part(path: str, dtype: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc_ids, offsets, ids) of a part: memory-mapped on a file system that has maps, else read."""
    store, at = _store(path)
    if type(store).__name__ == "LocalFileSystem":
        index = np.memmap(f"{at}.idx", "<i8", "r")
        ids = np.memmap(f"{at}.bin", dtype, "r")
    else:
        index = np.frombuffer(store.open_input_file(f"{at}.idx").read(), "<i8")
        ids = np.frombuffer(store.open_input_file(f"{at}.bin").read(), dtype)
    n = int(index[0])
    return index[1 : n + 1], index[n + 1 :], ids


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document of a folder, from its files."""
    manifest = spark.read.parquet(f"{folder}/manifest").select("part", "path", "dtype")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                docs, offsets, ids = open_part(r["path"], r["dtype"])
                base, cut = int(offsets[0]), offsets.tolist()
                for k in range(0, len(docs), 10_000):
                    spans = list(zip(cut[k : k + 10_000], cut[k + 1 : k + 10_001]))
                    crc = [zlib.crc32(ids[a - base : b - base].astype("<u4").tobytes()) for a, b in spans]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.array(docs[k : k + len(spans)])), pa.array([a for a, _ in spans], pa.int64()), pa.array([b - a for a, b in spans], pa.int64()), pa.array(crc, pa.int64())],
                        names=["doc_id", "start", "n_tokens", "ids_crc32"],
                    )

    return manifest.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "part").mapInArrow(read, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint").withColumn("doc_id", F.nullif("doc_id", F.lit(NO_ID)))


def public_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of all whole texts of documents, read back: see write_token_files."""
    folder = f"{shared_folder(spark)}/tokens-{uuid.uuid4().hex}"
    write_token_files(table(spark, sf_dir, "documents"), folder, public_vocabulary())
    return read_token_files(spark, folder)
