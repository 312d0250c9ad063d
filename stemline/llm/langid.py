"""Language identification by cross-parsing: the language whose labelled text parses a text into the cheapest phrases wins."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stemline.llm.common import held, table

#: The bounded training sample: documents a language (twice that, expected, are fetched, so that as many remain), characters of
#: one of them, characters of running text a language and of all languages together, and languages, the most frequent first.
SAMPLE_DOCS, SAMPLE_CHARS, LANG_CHARS, ALL_CHARS, LANGUAGES = 60, 4_000, 60_000, 480_000, 256
#: What a text without a letter is.
UNDETERMINED = "und"

_WORD = re.compile(r"[^\W\d_]+")


def has_letter(text: str) -> bool:
    """A numeral such as a superscript is no letter, though a word character."""
    return any(any(map(str.isalpha, m[0])) for m in _WORD.finditer(text))


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def running(words: list[str]) -> str:
    """Words as they stand in a text, a blank before and behind each."""
    return f" {' '.join(words)} " if words else ""


class SuffixAutomaton:
    """All substrings of a text, as an automaton grown character by character; a state is the dictionary of its transitions."""

    def __init__(self, text: str):
        step: list[dict] = [{}]
        link, length, last = [-1], [0], 0
        for c in text:
            cur = len(step)
            step.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p >= 0 and c not in step[p]:
                step[p][c] = cur
                p = link[p]
            if p >= 0:
                q = step[p][c]
                if length[q] == length[p] + 1:
                    link[cur] = q
                else:
                    twin = len(step)
                    step.append(dict(step[q]))
                    length.append(length[p] + 1)
                    link.append(link[q])
                    link[q] = link[cur] = twin
                    while p >= 0 and step[p].get(c) == q:
                        step[p][c] = twin
                        p = link[p]
            last = cur
        for state in step:
            for c, k in state.items():
                state[c] = step[k]
        self.root = step[0]

    def phrases(self, text: str) -> int:
        """Phrases of the cross-parsing: each the longest match from where the one before ended, one character at least."""
        root = here = self.root
        count = 0
        for c in text:
            k = here.get(c)
            if k is None:
                if here is not root:
                    count += 1
                    k = root.get(c)
                if k is None:  # a character that the language doesn't have is a phrase
                    count += 1
                    k = root
            here = k
        return count + (here is not root)


class CrossParser:
    """Phrase costs of whole running texts under each language.

    model: (language, labelled running text) pairs. A phrase costs the logarithm of the
    length of the longest such text under all languages, so that a short one doesn't make phrases cheap.
    """

    def __init__(self, model: list[tuple[str, str]]):
        self.languages = [k for k, _ in model]
        self._automata = [SuffixAutomaton(text) for _, text in model]
        self._bits = math.log2(max((len(text) for _, text in model), default=0) + 2)

    def costs(self, text: str) -> np.ndarray:
        """Bits that the whole text takes under each language."""
        parsed = running(words_of(text))
        return np.array([a.phrases(parsed) for a in self._automata]) * self._bits

    def predict(self, text: str | None) -> tuple[str, float]:
        """Language and its share of the probability that the costs stand for; ties go to the language named first."""
        if not text or not self.languages or not has_letter(text):
            return UNDETERMINED, 0.0
        bits = self.costs(text)
        best = int(bits.argmin())
        return self.languages[best], float(1 / np.exp2(np.maximum(bits[best] - bits, -1000)).sum())


def _fold(id_col: str, n: int) -> F.Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % n


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> list[tuple[str, str]]:
    """(language, running text) for each learned language, most frequent first.

    Learns from labelled rows outside the held-out fold. The rows of a language
    with the smallest hashes of their ids are its sample, within the documented bounds; their words follow each other as they stand, whole,
    however long. Rows without a letter teach nothing, and a language that has no others isn't learned.
    """
    rows = docs.select(F.col(id_col).alias("i"), F.col(text_col).cast("string").alias("t"), F.col(lang_col).cast("string").alias("g")).where((_fold("i", 3) != 1) & F.col("t").rlike(r"\p{L}") & F.col("g").isNotNull())
    counts = rows.groupBy("g").count().orderBy(F.desc("count"), "g").limit(LANGUAGES).collect()
    if not counts:
        return []
    spin = F.pmod(F.xxhash64("i"), F.lit(1 << 30))
    share = F.create_map(*[F.lit(x) for r in counts for x in (r["g"], min(1 << 30, (2 * SAMPLE_DOCS << 30) // r["count"] + 1))])
    picked = rows.withColumn("h", spin).where(F.col("h") < share[F.col("g")])
    picked = picked.select("g", "h", F.substring("t", 1, SAMPLE_CHARS).alias("t")).orderBy("h").limit(4 * SAMPLE_DOCS * len(counts)).collect()
    model, most = [], min(LANG_CHARS, ALL_CHARS // len(counts))
    for r in counts:
        words: list[str] = []
        size = 0
        for x in [x for x in picked if x["g"] == r["g"]][:SAMPLE_DOCS]:
            for w in words_of(x["t"]) if size < most else ():
                words.append(w)
                size += len(w) + 1
                if size >= most:
                    break
        if words:
            model.append((r["g"], running(words)))
    return model


def annotate(docs: DataFrame, model: list[tuple[str, str]], text_col: str = "text", lang_as: str = "lang_pred", score_as: str = "score") -> DataFrame:
    """docs with the predicted language and its score behind its columns; no shuffle."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    names = docs.columns
    inner = [f"c{k}" for k in range(len(names))]
    at = names.index(text_col)
    schema = T.StructType([T.StructField(n, f.dataType, True) for n, f in zip(inner, docs.schema.fields)] + [T.StructField("p", T.StringType()), T.StructField("s", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = held(f"languages {hash(tuple(shared.value))}", lambda: CrossParser(shared.value))
        for batch in batches:
            got = [parser.predict(t.as_py()) for t in batch.column(at)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([g for g, _ in got], pa.string()), pa.array([s for _, s in got], pa.float64())], names=[*inner, "p", "s"])

    return docs.toDF(*inner).mapInArrow(run, schema).toDF(*names, lang_as, score_as)


def language_id(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for each row.

    Null texts and texts without a letter are `und` with score 0, and so is
    everything if no row is labelled. A null id is in no fold: such a row is neither learned from
    nor held out. lang, source and doc_id are inputs of the fit alone. Repeated rows are each returned. Whole texts are parsed, of any
    length, at a cost that grows with the number of languages; other columns, whatever their names, are ignored; an empty table gives no rows.
    """
    model = fit(docs, id_col, text_col, lang_col)
    slim = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(_fold(id_col, 3) == 1, F.lit(False)).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    return annotate(slim, model).select("doc_id", "held_out", "lang_pred", "score")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of all whole texts of documents: see language_id."""
    return language_id(table(spark, sf_dir, "documents"))
