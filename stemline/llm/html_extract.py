"""Main text of web pages by a site style tree.

The pages of a host are merged into one tree of styles (tag, class, id, role). A node that holds text is important if its
contents differ from page to page (content entropy), one with branches if their kinds do (presentation
entropy); what a branch holds is passed up to the nodes above it, weighed by its text. Branches of
low importance are taken out of each page, and so are single contents that most pages of a host
hold at the same place. What class, id, role and tag say about a branch is a prior: it scales the importance.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest, xxh128_digest

from stemline.llm.common import checkpoint, table

#: Distinct pages of a host from which its own tree judges a node, and hosts from which the tree of all hosts does.
HOST_PAGES, ALL_HOSTS = 4, 8
#: Importance (0 to 1) below which a branch is taken out, and how fast more presentations count for more.
LOW, DECAY = 0.35, 0.9
#: What is left of a branch's importance where its style speaks against it plainly, or in part.
PLAIN, PARTLY = 0.1, 0.5
#: Importance below which a branch is taken out if its style speaks against it in part.
MIDDLING = LOW / PARTLY
#: Part of a page's text from which a branch is the page, whatever its style says.
WHOLE = 0.9
#: Rows of the table of low nodes that may be broadcast: at 200 bytes, 20 MB at most.
BROADCAST_NODES = 100_000
#: The host that stands for all hosts; no URL has it.
EVERYWHERE = "*"

_BLOCKS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 header hr html iframe li main menu nav noscript object ol option p pre search section select summary table tbody td tfoot th thead tr ul".split()
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: What an opening tag ends when it is open.
_ENDS = {"p": "p", "li": "li", "dt": "dt dd", "dd": "dt dd", "tr": "tr td th", "td": "td th", "th": "td th", "option": "option"}
#: Blocks that end an open paragraph.
_END_P = _BLOCKS - {"body", "html", "button", "object", "iframe", "noscript"}
#: Barriers to implied ends: an li ends an li of its own list alone.
_SCOPE = {"li": frozenset(("ul", "ol", "menu")), "dt": frozenset(("dl",)), "dd": frozenset(("dl",)), "tr": frozenset(("table",)), "td": frozenset(("table", "tr")), "th": frozenset(("table", "tr")), "option": frozenset(("select",)), "p": frozenset(("div", "td", "li", "section", "article", "body", "blockquote"))}

NOISE_TAGS = frozenset("nav footer aside header form button select option menu dialog noscript iframe fieldset object search".split())
MAIN_TAGS = frozenset(("article", "main"))
#: Words of class, id and role that mark a branch as no part of the article.
NOISE_WORDS = frozenset(
    "ad ads adbox adslot advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies copyright disclaimer disqus"
    " footer form header login masthead menu modal nav navbar navigation newsletter notice notices notification popup promo promoted promotion recommended related"
    " replies search share sharing sidebar signup social sponsor sponsored subscribe toolbar topbar warning widget".split()
)
MAIN_WORDS = frozenset("article content entry main post story text".split())

#: Comments, raw elements, declarations, tags; possessive, so that a broken page costs no more than a whole one.
_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>script|style|textarea|title|template|svg|math|canvas)\b(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>.*?(?:</(?P=raw)\s*+>|\Z)"
    r"|<[!?][^>]*+>"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(?P<end2>/?)(?P<name2>[a-zA-Z][^\s/>]*+)(?P<attrs2>[^>]*+)>",
    re.S | re.I,
)
_ATTR = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)


@lru_cache(maxsize=10_000)
def style(name: str, attrs: str) -> tuple[str, int]:
    """(label of a node, what its own style says: 1 content, -2 no content, -1 no content in part, 0 nothing).

    A class, id or role all of whose words are noise speaks plainly, one with some noise words in part; a word for content outweighs the latter.
    """
    names: list[list[str]] = []
    for _, a, b, c in _ATTR.findall(attrs):
        names += [re.findall(r"[a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", x).lower()) for x in (a or b or c).split()]
    words = sorted({w for x in names for w in x})
    label = ".".join([name, *words] if len(words) <= 4 else [name, *words[:4], f"{xxh64_intdigest('.'.join(words)):x}"])
    if name in ("body", "html"):
        return label, 0
    if name in NOISE_TAGS or any(x and all(w in NOISE_WORDS for w in x) for x in names):
        return label, -2
    main = name in MAIN_TAGS or any(w in MAIN_WORDS for w in words)
    partly = any(w in NOISE_WORDS for w in words)
    return label, int(main) - int(partly)


class Page:
    """Blocks of a page in order, as (node, text), and its nodes, those above before those below.

    A node is a path of styles, by its hash; 0 is the page itself. up: the node above; says: what its style says; kinds: hashes of the styles below it.
    """

    __slots__ = ("blocks", "up", "says", "kinds", "_open", "_run", "_known")

    def __init__(self, source: str):
        self.blocks: list[tuple[int, str]] = []
        self.up: dict[int, int] = {}
        self.says: dict[int, int] = {}
        self.kinds: dict[int, dict[int, None]] = {0: {}}
        self._open: list[tuple[str, int, bool]] = []
        self._known: dict[tuple[int, str], int] = {}
        self._run: list[str] = []
        at, run = 0, self._run
        for m in _TAG.finditer(source):
            if m.start() > at:
                run.append(source[at : m.start()])
            at = m.end()
            name = m["name"] or m["name2"]
            if name is None:
                continue
            name = name.lower()
            if name not in _BLOCKS:
                if name == "br":
                    run.append("\n")
                continue
            self._flush()
            if m["end"] or m["end2"]:
                self._close(name)
            else:
                self._start(name, m["attrs"] or m["attrs2"] or "")
        run.append(source[at:])
        self._flush()

    def _start(self, name: str, attrs: str) -> None:
        if name in ("html", "body"):
            return
        ends, scope = _ENDS.get(name, "").split(), _SCOPE.get(name, ())
        if name in _END_P and name != "p":
            self._implied(["p"], _SCOPE["p"])
        if ends:
            self._implied(ends, scope)
        if name in _VOID:
            return
        label, says = style(name, attrs)
        above, main = self._open[-1][1:] if self._open else (0, False)
        if name == "header" and main:  # an article's own heading
            says = 0
        node = self._known.get((above, label))
        if node is None:
            node = self._known[above, label] = xxh64_intdigest(f"{above:x}>{label}") >> 1
            self.up[node], self.says[node], self.kinds[node] = above, says, {}
            self.kinds[above][xxh64_intdigest(label) >> 1] = None
        self._open.append((name, node, says == 1 or main and says >= 0))

    def _implied(self, names: list[str], scope) -> None:
        for k in range(len(self._open) - 1, -1, -1):
            if self._open[k][0] in names:
                del self._open[k:]
                return
            if self._open[k][0] in scope:
                return

    def _close(self, name: str) -> None:
        for k in range(len(self._open) - 1, -1, -1):
            if self._open[k][0] == name:
                del self._open[k:]
                return

    def _flush(self) -> None:
        if not self._run:
            return
        text = "".join(self._run)
        self._run.clear()
        if "&" in text:
            text = entities.unescape(text)
        text = " ".join(text.split())
        if text:
            self.blocks.append((self._open[-1][1] if self._open else 0, text))

    def priors(self) -> dict[int, int]:
        """What the styles of a node and of those above it say against it (0, -1, -2), but for those that hold all but all of the page's text."""
        size: dict[int, int] = dict.fromkeys(self.up, 0)
        whole = 0
        for node, text in self.blocks:
            whole += len(text)
            size[node] = size.get(node, 0) + len(text)
        for node, above in reversed(self.up.items()):
            if above:
                size[above] += size[node]
        out = {0: 0}
        for node, above in self.up.items():
            own = 0 if size[node] > WHOLE * whole else min(0, self.says[node])
            out[node] = min(own, out[above])
        return out


def host_of(url: str | None) -> str:
    m = re.match(r"\s*(?:[a-zA-Z][\w+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", url or "")
    return m[1].lower() if m else ""


def content_key(node: int, text: str) -> int:
    """A content at its place in the tree; negative, so that it is no node."""
    return -1 - (xxh64_intdigest(f"{node:x}>{xxh64_intdigest(text):x}") >> 2)


# ---- the tree

def parsed(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(host, digest, nodes, contents) of each distinct page of a host: (node, up, kinds) and (node, content, chars) one after the other.

    A page that repeats counts once, so that copies don't make an article look like a menu.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts, digests, nodes, contents = [], [], [], []
            for u, h in zip(batch["url"].to_pylist(), batch["html"].to_pylist()):
                page = Page(h or "")
                if not page.blocks:
                    continue
                here = {content_key(node, text): (node, len(text)) for node, text in page.blocks}
                whole = [(0, -1, _kinds(page.kinds[0])), *((node, above, _kinds(page.kinds[node])) for node, above in page.up.items())]
                hosts.append(host_of(u))
                nodes.append([x for row in whole for x in row])
                contents.append([x for key, (node, size) in here.items() for x in (node, key, size)])
                digests.append(xxh64_intdigest(repr((nodes[-1], contents[-1]))) >> 1)
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(digests, pa.int64()), pa.array(nodes, pa.list_(pa.int64())), pa.array(contents, pa.list_(pa.int64()))], names=["host", "digest", "nodes", "contents"])

    slim = pages.select(F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    rows = slim.mapInArrow(run, "host string, digest bigint, nodes array<bigint>, contents array<bigint>")
    return rows.groupBy("host", "digest").agg(F.first("nodes").alias("nodes"), F.first("contents").alias("contents"))


def _kinds(labels: dict[int, None]) -> int:
    return xxh64_intdigest(repr(sorted(labels))) >> 1 if labels else 0


def _triples(rows: DataFrame, column: str, names: list[str]) -> DataFrame:
    at = F.transform(F.sequence(F.lit(1), F.size(column), F.lit(3)), lambda k: F.slice(column, k, 3))
    return rows.where(F.size(column) > 0).select("host", F.explode(at).alias("x")).select("host", *[F.col("x")[k].alias(n) for k, n in enumerate(names)])


def subtree_sums(nodes: DataFrame, sums: list[str]) -> DataFrame:
    """nodes(host, node, up, sums...) with the sums over each node and all below it.

    After k rounds a node has the sums of the 2^k levels below it and points 2^k levels up, so that rounds are as many as the depth has binary digits.
    """
    held = checkpoint(nodes.select("host", "node", "up", *sums))
    while not held.where("up >= 0").isEmpty():
        up = held.where("up >= 0").groupBy("host", F.col("up").alias("node")).agg(*[F.sum(c).alias(f"{c}_below") for c in sums])
        jump = held.select("host", F.col("node").alias("up"), F.col("up").alias("next"))
        held = held.join(up, ["host", "node"], "left").join(jump, ["host", "up"], "left")
        held = checkpoint(held.select("host", "node", F.coalesce("next", F.lit(-1)).alias("up"), *[(F.col(c) + F.coalesce(f"{c}_below", F.lit(0))).alias(c) for c in sums]))
    return held.drop("up")


def _enough() -> F.Column:
    return F.col("pages") >= F.when(F.col("host") == EVERYWHERE, ALL_HOSTS).otherwise(HOST_PAGES)


def _on_most() -> F.Column:
    """Contents that most pages with their node hold."""
    return _enough() & (F.col("on") * 2 > F.col("of"))


def importance(nodes: DataFrame, contents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(host, node, pages, importance) of branches, and (host, content, pages, of, on) of contents, from nodes(host, node, up, kinds, n, of) and contents(host, node, content, chars, n, on).

    A content on n of the m pages of its node has the importance 1 - log n / log m. A branch has the mean of what it holds, by characters and but for what goes anyway, and the
    presentation entropy of its own kinds of branches to the base m; of several presentations the latter counts for 1 - DECAY^(kinds - 1).
    Only sums are gathered, contents first and then nodes, so a host with a third of all pages is pre-aggregated like any other.
    """
    n = F.col("n")
    own = nodes.groupBy("host", "node", "up").agg(F.sum("n").alias("pages"), F.sum("of").alias("of"), F.count(F.lit(1)).alias("several"), F.sum(n * F.log(n)).alias("spread"))
    own = checkpoint(own)
    placed = checkpoint(contents.join(own.select("host", "node", "pages", "of"), ["host", "node"]))
    worth = F.when(F.col("pages") > 1, 1 - F.log(n) / F.log("pages")).otherwise(1.0)
    text = placed.where(~_on_most()).groupBy("host", "node").agg(F.sum(F.col("chars") * n).cast("double").alias("size"), F.sum(F.col("chars") * n * worth).alias("worth"))
    held = own.join(text, ["host", "node"], "left").fillna(0.0, ["size", "worth"])
    sums = subtree_sums(held, ["size", "worth"])
    whole = own.join(sums, ["host", "node"])
    shown = F.when(F.col("pages") > 1, 1 - F.col("spread") / F.col("pages") / F.log("pages")).otherwise(1.0)
    trust = F.pow(F.lit(DECAY), F.col("several") - 1)
    content = F.when(F.col("size") > 0, F.col("worth") / F.col("size")).otherwise(0.0)
    return whole.select("host", "node", "pages", ((1 - trust) * shown + trust * content).alias("importance")), placed.select("host", "content", "pages", "of", "on")


def low_nodes(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(host, key, level): nodes of importance under LOW (level 2) or under MIDDLING (1), and contents that most pages with their node hold (2).

    By the host's own tree, and by the tree of all hosts (host EVERYWHERE), in which a host counts once for a node's importance.
    """
    rows = checkpoint(parsed(pages, url_col, html_col))
    nodes = _triples(rows, "nodes", ["node", "up", "kinds"]).groupBy("host", "node", "up", "kinds").agg(F.count(F.lit(1)).alias("n")).withColumn("of", F.col("n"))
    contents = _triples(rows, "contents", ["node", "content", "chars"]).groupBy("host", "node", "content", "chars").agg(F.count(F.lit(1)).alias("n")).withColumn("on", F.col("n"))
    nodes, contents = checkpoint(nodes), checkpoint(contents)
    one = F.lit(EVERYWHERE).alias("host")
    nodes = nodes.unionByName(nodes.groupBy("node", "up", "kinds").agg(F.count(F.lit(1)).alias("n"), F.sum("of").alias("of")).select(one, "*"))
    contents = contents.unionByName(contents.groupBy("node", "content", "chars").agg(F.count(F.lit(1)).alias("n"), F.sum("on").alias("on")).select(one, "*"))
    branch, leaf = importance(nodes, contents)
    level = F.when(F.col("importance") < LOW, 2).when(F.col("importance") < MIDDLING, 1).otherwise(0).alias("level")
    # the page itself is listed in any case: it shows that a host has a tree of its own
    low = branch.where(_enough() & ((F.col("importance") < MIDDLING) | (F.col("node") == 0))).select("host", F.col("node").alias("key"), level)
    return low.unionByName(leaf.where(_on_most()).select("host", F.col("content").alias("key"), F.lit(2).alias("level")))


# ---- what is left of a page

def text_of(page: Page, low: dict[int, int]) -> str:
    """Text of the blocks that are in no branch of low importance; low: levels by node and content."""
    priors, gone = page.priors(), {0: low.get(0) == 2}
    for node, above in page.up.items():
        level, prior = low.get(node, 0), priors[node]
        gone[node] = gone[above] or level == 2 or prior == -2 or level == 1 and prior == -1
    return "\n".join(text for node, text in page.blocks if not gone[node] and content_key(node, text) not in low)


_SCHEMA = "page_id bigint, url string, text string, n_chars bigint"


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of each page.

    Null or empty html has empty text; pages with a null url are judged by the tree of the
    empty host, and null ids are kept. Repeated rows are each returned and count once in the tree. A page whose branches are all
    judged unimportant has empty text. Nesting of any depth and texts of any length are taken whole; other columns, whatever
    their names, are ignored; an empty table gives no rows.
    """
    low = checkpoint(low_nodes(pages, url_col, html_col))
    slim = pages.select(F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    if low.count() <= BROADCAST_NODES:
        table_: dict[str, dict[int, int]] = {}
        for r in low.collect():
            table_.setdefault(r["host"], {})[r["key"]] = r["level"]
        shared = pages.sparkSession.sparkContext.broadcast(table_)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            everywhere = shared.value.get(EVERYWHERE, {})
            for batch in batches:
                yield _texts(batch, (shared.value.get(host_of(u), everywhere) for u in batch["url"].to_pylist()))

        return slim.mapInArrow(run, _SCHEMA)
    # more: what a page asks for meets the table by host and key; equal pages of a host ask once
    known = low.select(F.col("host").alias("known_host")).distinct()

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[tuple, None] = {}
            for u, h in zip(batch["url"].to_pylist(), batch["html"].to_pylist()):
                page, host = Page(h or ""), host_of(u)
                ident = _ident(host, h)
                found.update(dict.fromkeys((ident, host, k) for k in (0, *page.up, *(content_key(*b) for b in page.blocks))))
            rows = list(found)
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.binary(), pa.string(), pa.int64()))], names=["ident", "of_host", "of_key"])

    asked = slim.where("html is not null").select("url", "html").mapInArrow(keys, "ident binary, of_host string, of_key bigint").distinct()
    asked = asked.join(known, F.col("of_host") == F.col("known_host"), "left").withColumn("of_host", F.when(F.col("known_host").isNotNull(), F.col("of_host")).otherwise(EVERYWHERE))
    found = asked.join(low, (F.col("of_host") == F.col("host")) & (F.col("of_key") == F.col("key")))
    found = found.groupBy("ident").agg(F.map_from_entries(F.collect_set(F.struct("key", "level"))).alias("low"))

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            idents = [_ident(host_of(u), h) for u, h in zip(batch["url"].to_pylist(), batch["html"].to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(idents, pa.binary())], names=["page_id", "url", "html", "of"])

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _texts(batch, (dict(x or ()) for x in batch["low"].to_pylist()))

    met = slim.mapInArrow(named, "page_id bigint, url string, html string, of binary").join(found, F.col("of") == F.col("ident"), "left")
    return met.select("page_id", "url", "html", "low").mapInArrow(joined, _SCHEMA)


def _ident(host: str, html: str | None) -> bytes:
    return xxh128_digest(f"{host}\n{html or ''}")


def _texts(batch: pa.RecordBatch, lows) -> pa.RecordBatch:
    texts = [text_of(Page(h or ""), low) for h, low in zip(batch["html"].to_pylist(), lows)]
    return pa.RecordBatch.from_arrays([batch["page_id"], batch["url"], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def op9_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main texts of all whole pages: see extract."""
    return extract(table(spark, sf_dir, "pages"))
