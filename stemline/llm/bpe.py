"""Byte-level BPE, encoded by dynamic programming over prefixes.

For every prefix of a piece exactly one token can end its encoding. A
suffix-matching automaton over the vocabulary lists the tokens that end at each
prefix; the one that is kept is the one that is compatible with the last token of the prefix before it.
Back-pointers from the whole piece then give the ids that the merges would give, in
time that grows with the piece alone, however long it is.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stemline.llm.common import held, table

#: Words whose ids a worker keeps, twice over (since the last but one clearing), and the longest that it keeps.
CACHE_ENTRIES, CACHE_CHARS = 250_000, 48

#: Latin letters, then at most one run of marks: two pieces at most, cut without the library.
_WORD = re.compile(r"([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+)([.,;:!?]*)")


class _Uneven(Exception):
    """A blank other than space and line feed."""


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary: printable Latin-1 for itself, the others from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Kept(dict):
    """Ids by word, made by make(word) when first asked for; words not asked for since the last but one filling go."""

    def __init__(self, make):
        super().__init__()
        self.make, self.old = make, {}

    def __missing__(self, key: str) -> bytes:
        ids = self.old.get(key)
        if ids is None:
            ids = self.make(key)
        if len(key) <= CACHE_CHARS:
            if len(self) >= CACHE_ENTRIES:
                self.old = self.copy()
                self.clear()
            self[key] = ids
        return ids


class PrefixBpe:
    """A byte-level BPE vocabulary file, as encoder and decoder."""

    def __init__(self, path: str):
        import ahocorasick
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self._cut = Tokenizer.from_file(path).pre_tokenizer
        alphabet = byte_alphabet()
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self._added_at = re.compile("|".join(map(re.escape, sorted(self.added, key=len, reverse=True)))) if self.added else None
        self.bytes_of = [b""] * (max([*vocab.values(), *self.added.values()]) + 1)
        for word, k in vocab.items():
            if word not in self.added:
                self.bytes_of[k] = bytes(alphabet[c] for c in word)
        for word, k in self.added.items():
            self.bytes_of[k] = word.encode()
        #: rank of a merge of two ids; the two ids and the rank that make an id
        self.rank: dict[tuple[int, int], int] = {}
        self.made: dict[int, tuple[int, int, int]] = {}
        for r, m in enumerate(merges):
            left, right = m if isinstance(m, list) else m.split(" ")
            pair, k = (vocab[left], vocab[right]), vocab[left + right]
            self.rank[pair] = r
            self.made.setdefault(k, (*pair, r))
        self._fits: dict[int, bool] = {}
        self._whole: dict[int, bool] = {}  # do the merges turn an id's bytes into it alone?
        self._auto = ahocorasick.Automaton()
        for word, k in vocab.items():
            if word in self.added:
                continue
            made = self.made.get(k)
            if made is None and len(self.bytes_of[k]) != 1 or not self.whole(k):
                continue  # no merges lead to it
            self._auto.add_word(self.bytes_of[k].decode("latin-1"), (k, len(self.bytes_of[k])))
        self._auto.make_automaton()
        self.spaced = Kept(lambda chunk: self._word(" ", chunk))
        self.bare = Kept(lambda chunk: self._word("", chunk))
        self._feed = np.array(self.encode_bytes(b"\n"), "<u4").tobytes()

    def fits(self, left: int, right: int) -> bool:
        """Whether the merges keep left and right apart, where each by itself is what its bytes become.

        Undo merges on either side of the border, latest first, and see whether at any
        time a merge across the border would have come before the merge that was undone on its side.
        """
        a, b = left, right
        born_a = born_b = len(self.rank)  # when what stands at the border stopped standing there
        ok = True
        while True:
            r = self.rank.get((a, b))
            # of equal ranks the leftmost place goes first: the left token's own merge wins, the right one's does not
            if r is not None and r < born_a and r <= born_b:
                ok = False
                break
            ma, mb = self.made.get(a), self.made.get(b)
            if ma is None and mb is None:
                break
            if mb is None or (ma is not None and ma[2] > mb[2]):
                born_a, a = ma[2], ma[1]
            else:
                born_b, b = mb[2], mb[0]
        if len(self._fits) >= CACHE_ENTRIES:
            self._fits.clear()
        self._fits[left << 32 | right] = ok
        return ok

    def whole(self, k: int) -> bool:
        known = self._whole.get(k)
        if known is None:
            made = self.made.get(k)
            known = self._whole[k] = made is None or (self.whole(made[0]) and self.whole(made[1]) and self._halves(made))
        return known

    def _halves(self, made: tuple[int, int, int]) -> bool:
        """Whether made's halves stay apart until their own merge."""
        a, b, r = made
        born_a = born_b = r
        while True:
            ma, mb = self.made.get(a), self.made.get(b)
            if ma is None and mb is None:
                return True
            if mb is None or (ma is not None and ma[2] > mb[2]):
                born_a, a = ma[2], ma[1]
            else:
                born_b, b = mb[2], mb[0]
            x = self.rank.get((a, b))
            if x is not None and x < born_a and x <= born_b:
                return False

    def encode_bytes(self, piece: bytes) -> list[int]:
        """Ids of one piece."""
        n = len(piece)
        last, start = [-1] * (n + 1), [0] * (n + 1)  # the last token of each prefix, and where it begins
        known, fits = self._fits.get, self.fits
        for end, (k, size) in self._auto.iter(piece.decode("latin-1")):
            end += 1
            if last[end] >= 0:
                continue
            at = end - size
            if at == 0:
                last[end] = k
            elif (left := last[at]) >= 0:
                ok = known(left << 32 | k)
                if fits(left, k) if ok is None else ok:
                    last[end], start[end] = k, at
        ids = []
        while n:
            ids.append(last[n])
            n = start[n]
        return ids[::-1]

    def _word(self, space: str, chunk: str) -> bytes:
        """Ids of what stands between two blanks, with the space before it."""
        if m := _WORD.fullmatch(chunk):
            ids = self.encode_bytes((space + m[1]).encode())
            return np.array(ids + self.encode_bytes(m[2].encode()) if m[2] else ids, "<u4").tobytes()
        if any(map(str.isspace, chunk)):
            raise _Uneven
        return self._cut_and_encode(space + chunk)

    def _cut_and_encode(self, text: str) -> bytes:
        ids: list[int] = []
        for marked, _ in self._cut.pre_tokenize_str(text):
            ids += self.encode_bytes(bytes(map(_ALPHABET.__getitem__, marked)))
        return np.array(ids, "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers."""
        if self._added_at is not None and (found := list(self._added_at.finditer(text))):
            out, at = [], 0
            for m in found:
                out += [self._plain(text[at : m.start()]), np.array([self.added[m[0]]], "<u4").tobytes()]
                at = m.end()
            return b"".join([*out, self._plain(text[at:])])
        return self._plain(text)

    def _plain(self, text: str) -> bytes:
        if not text:
            return b""
        if "  " in text or "\n\n" in text or " \n" in text or "\n " in text or text[0].isspace() or text[-1].isspace():
            return self._cut_and_encode(text)
        # one blank between any two words: a piece takes the space before its word, and a line feed is a piece
        bare, spaced, out = self.bare, self.spaced.__getitem__, []
        try:
            for k, line in enumerate(text.split("\n")):
                if k:
                    out.append(self._feed)
                first, *rest = line.split(" ")
                out.append(bare[first])
                out += map(spaced, rest)
        except _Uneven:
            return self._cut_and_encode(text)
        return b"".join(out)

    def decode(self, ids: bytes) -> bytes:
        """The decoded text in UTF-8; bytes that aren't UTF-8 become U+FFFD, as the tokenizers library has it."""
        raw = b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))
        return raw.decode("utf-8", "replace").encode()


_ALPHABET = byte_alphabet()


def load(path: str) -> PrefixBpe:
    """The vocabulary at path, read once by each worker."""
    return held(f"bpe {path}", lambda: PrefixBpe(path))


def public_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def bpe_encode(docs: DataFrame, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids binary, decoded string): ids as little-endian unsigned 32-bit integers.

    One row for each row of docs, in its partition: no shuffle. A null text counts as empty and has no ids. Other columns are ignored.
    """
    path = vocabulary or public_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = load(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                ids = [coder.encode(t or "") for t in part["text"].to_pylist()]
                yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array(ids, pa.binary()), pa.array([coder.decode(x).decode() for x in ids], pa.string())], names=["doc_id", "ids", "decoded"])

    return _ids_and_text(docs, id_col, text_col).mapInArrow(run, "doc_id bigint, ids binary, decoded string")


def bpe_digest(docs: DataFrame, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of bpe_encode(), digested where it is made.

    Null texts count as empty; null ids and repeated rows are returned as they are; texts of any length are encoded
    whole; other columns, whatever their names, are ignored; an empty table gives no rows.
    """
    path = vocabulary or public_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, sha = load(path), hashlib.sha256
        for batch in batches:
            n, a, b = [], [], []
            for t in batch["text"]:
                ids = coder.encode(t.as_py() or "")
                n.append(len(ids) // 4)
                a.append(sha(ids).hexdigest())
                b.append(sha(coder.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return _ids_and_text(docs, id_col, text_col).mapInArrow(run, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def _ids_and_text(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the ids and decoded text of all whole texts of documents: see bpe_digest."""
    return bpe_digest(table(spark, sf_dir, "documents"))
