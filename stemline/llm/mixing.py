"""Mixing sources to target weights by hierarchical budgeting, in DataFrame operations only."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stemline.llm.common import checkpoint, table

#: Target weights, whole numbers; a name that isn't listed weighs 1.
DOMAIN_WEIGHTS: dict[str, int] = {"d0": 4, "d1": 3, "d2": 2, "d3": 1}
LANG_WEIGHTS: dict[str, int] = {"en": 4, "de": 2, "fr": 2, "es": 1}
SOURCE_WEIGHTS: dict[str, int] = {"src0": 2}
#: Times that a document may be read, and the seed of the epochs' orders.
MAX_EPOCHS, SEED = 4, 17
#: Leaves that may be broadcast: at 200 bytes, 20 MB at most.
BROADCAST_LEAVES = 100_000
#: Rows of a leaf for each of its hash buckets, about.
BUCKET_ROWS = 4096

LEAF = ["domain", "lang", "source"]


def domain_of(source: F.Column) -> F.Column:
    """Domain of a source where the table has none: four groups, by the MD5 of its name."""
    digit = F.instr(F.lit("0123456789abcdef"), F.substring(F.md5(source.cast("binary")), 1, 1))
    return F.concat(F.lit("d"), F.floor((digit - 1) / 4).cast("string"))


def _weight(name: F.Column, weights: Mapping[str, int]) -> F.Column:
    if not weights:
        return F.lit(1).cast("bigint")
    listed = F.create_map(*[F.lit(x) for k, v in weights.items() for x in (k, v)])
    return F.coalesce(F.try_element_at(listed, name), F.lit(1)).cast("bigint")


def _small(df: DataFrame) -> DataFrame:
    """df written and, within BROADCAST_LEAVES rows, marked for broadcast."""
    df = checkpoint(df)
    return F.broadcast(df) if df.count() <= BROADCAST_LEAVES else df


def water_fill(children: DataFrame, parent: list[str], name: str, into: str) -> DataFrame:
    """children(parent..., name, weight, cap, budget) with into: its part of the parent's budget.

    Parts are in proportion to weights; a child whose weight is 0 or less gets nothing. A child that can't hold its part is filled, and
    what it lacks goes to its siblings in proportion to theirs. Sorted by
    cap / weight, the filled ones come first, so that one running sum finds the level; no rounds are needed.
    """
    part = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(0))
    # without weight: as if it could hold nothing, which comes first and takes nothing
    children = children.withColumn("cap", F.when(F.col("weight") > 0, F.col("cap")).otherwise(0)).withColumn("weight", F.when(F.col("weight") > 0, F.col("weight")).otherwise(1))
    before = part.orderBy(F.col("cap") / F.col("weight"), name).rowsBetween(Window.unboundedPreceding, -1)
    left = F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0))
    weight = F.sum("weight").over(part) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    ratio = F.col("cap") / F.col("weight")
    out = children.withColumn("_level", left / weight).withColumn("_full", ratio <= F.col("_level"))
    out = out.withColumn("_at", F.min(F.when(~F.col("_full"), F.struct(ratio.alias("r"), F.col(name).alias("n"), F.col("_level").alias("level")))).over(part)["level"])
    return out.withColumn(into, F.when(F.col("_full"), F.col("cap")).otherwise(F.floor(F.col("_at") * F.col("weight"))).cast("bigint")).drop("_level", "_full", "_at")


def leaf_of(docs: DataFrame) -> list[F.Column]:
    """The leaf's names; null ones are empty."""
    lang, source = (F.coalesce(docs[c].cast("string"), F.lit("")) if c in docs.columns else F.lit("") for c in ("lang", "source"))
    domain = F.coalesce(docs["domain"].cast("string"), F.lit("")) if "domain" in docs.columns else domain_of(source)
    return [domain.alias("domain"), lang.alias("lang"), source.alias("source")]


def leaves_and_tokens(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, the leaf's names, n_tokens: words between blanks."""
    words = F.regexp_count(F.coalesce(F.col(text_col).cast("string"), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"))
    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), *leaf_of(docs), words.cast("bigint").alias("n_tokens"))


def budgets(rows: DataFrame, max_epochs: int, share: tuple[int, int], domain_weights: Mapping[str, int], lang_weights: Mapping[str, int], source_weights: Mapping[str, int]) -> DataFrame:
    """For each leaf: rows, tokens, target (its part of the whole budget), full epochs and the tokens left for the last one."""
    leaf = checkpoint(rows.groupBy(*LEAF).agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("docs")))
    cap = (F.sum("tokens") * max_epochs).alias("cap")
    total = leaf.agg(F.floor(F.sum("tokens") * share[0] / share[1]).cast("bigint").alias("budget"))
    top = leaf.groupBy("domain").agg(cap).join(F.broadcast(total), F.lit(True)).withColumn("weight", _weight(F.col("domain"), domain_weights))
    shut = F.col("weight") <= 0
    top = water_fill(top.withColumn("shut", shut), [], "domain", "got").select("domain", F.col("got").alias("budget"), "shut")
    mid = leaf.groupBy("domain", "lang").agg(cap).join(top, "domain").withColumn("weight", _weight(F.col("lang"), lang_weights))
    mid = water_fill(mid.withColumn("shut", F.col("shut") | shut), ["domain"], "lang", "got").select("domain", "lang", F.col("got").alias("budget"), "shut")
    low = leaf.withColumn("cap", F.col("tokens") * max_epochs).join(mid, ["domain", "lang"]).withColumn("weight", _weight(F.col("source"), source_weights))
    low = water_fill(low.withColumn("shut", F.col("shut") | shut), ["domain", "lang"], "source", "target")
    some = F.col("tokens") > 0
    return low.select(
        *LEAF, "docs", "tokens", "target", "shut",
        F.when(some, F.expr("target div nullif(tokens, 0)")).otherwise((~F.col("shut")).cast("int")).cast("int").alias("full"),
        F.when(some, F.expr("target % nullif(tokens, 0)")).otherwise(0).cast("bigint").alias("rest"),
    )


def _spin(seed: int, full: str = "full", id_col: str = "doc_id") -> F.Column:
    """A document's place in the order of its leaf's last epoch."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(full).cast("string"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).cast("binary"))


def plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, share: tuple[int, int] = (1, 1), max_epochs: int = MAX_EPOCHS, seed: int = SEED,
         domain_weights: Mapping[str, int] = DOMAIN_WEIGHTS, lang_weights: Mapping[str, int] = LANG_WEIGHTS, source_weights: Mapping[str, int] = SOURCE_WEIGHTS) -> tuple[DataFrame, DataFrame]:
    """(documents with their leaf and tokens, leaves with full epochs and the cutoff of the last one).

    The token budget is share of all tokens. A document is in the last epoch's
    prefix if its place is at most the cutoff, so that only a row a leaf has to reach the documents. To find
    it, tokens are summed by leaf and hash bucket; running sums over the buckets show the one the prefix ends in, and
    only the documents of that bucket are put in order.
    """
    rows = checkpoint(leaves_and_tokens(docs, id_col, text_col))
    leaf = budgets(rows, max_epochs, share, domain_weights, lang_weights, source_weights)
    # hex digits of a bucket: 16 buckets for each factor of 16 in the leaf's rows over BUCKET_ROWS
    leaf = _small(leaf.withColumn("digits", F.greatest(F.lit(2.0), F.ceil(F.log(16.0, F.greatest(F.col("docs") / BUCKET_ROWS, F.lit(1.0))))).cast("int")))
    placed = rows.join(leaf.select(*LEAF, "full", "rest", "digits"), LEAF).withColumn("spin", _spin(seed)).withColumn("bucket", F.substring("spin", F.lit(1), F.col("digits")))
    sums = placed.groupBy(*LEAF, "rest", "bucket").agg(F.sum("n_tokens").alias("n"))
    upto = Window.partitionBy(*LEAF).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("before", F.coalesce(F.sum("n").over(upto), F.lit(0)))
    # the last bucket that fits whole, and the first that doesn't
    fits = F.col("before") + F.col("n") <= F.col("rest")
    ends = sums.groupBy(*LEAF).agg(F.max(F.when(fits, F.col("bucket"))).alias("whole"), F.min(F.when(~fits, F.struct("bucket", "before"))).alias("part"))
    ends = _small(ends.select(*LEAF, "whole", F.col("part.bucket").alias("in_bucket"), F.col("part.before").alias("spent")))
    last = placed.join(ends, LEAF).where(F.col("bucket") == F.col("in_bucket"))
    run = F.col("spent") + F.sum("n_tokens").over(Window.partitionBy(*LEAF).orderBy("spin").rangeBetween(Window.unboundedPreceding, Window.currentRow))
    cut = last.withColumn("run", run).where(F.col("run") <= F.col("rest")).groupBy(*LEAF).agg(F.max("spin").alias("in_cut"))
    cutoff = F.when(F.col("shut"), F.lit("")).otherwise(F.coalesce("in_cut", F.rpad("whole", 32, "g"), F.lit("")))
    return rows, _small(leaf.join(ends, LEAF).join(cut, LEAF, "left").select(*LEAF, "tokens", "target", "full", cutoff.alias("cutoff")))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """(doc_id, domain, lang, source, n_tokens, target, epochs): how many epochs take the document; 0 leaves it out.

    target is the leaf's token budget. Weights of 0 take the branch out, those without tokens included. Null languages and sources are names of their own (empty), null ids order as empty ids, null or
    empty texts have no tokens; a leaf without tokens is taken once. Documents that repeat an
    id share their place and are taken or left together. Rounding loses less than a token a node. Very long texts are counted whole; other columns, but for a domain, are
    ignored; an empty table gives no rows.
    """
    rows, leaf = plan(docs, id_col, text_col, **how)
    epochs = F.col("full") + (_spin(how.get("seed", SEED)) <= F.col("cutoff")).cast("int")
    return rows.join(leaf, LEAF).select("doc_id", *LEAF, "n_tokens", "target", epochs.cast("bigint").alias("epochs"))


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """docs with each row as often as epochs take it; its own columns alone, and no shuffle of texts while the leaves are few."""
    _, leaf = plan(docs, id_col, text_col, **how)
    names = docs.columns
    inner = [f"c{k}" for k in range(len(names))]  # whatever the columns are called
    keyed = docs.select(*[F.col(f"`{c}`") for c in names], F.struct(*leaf_of(docs)), F.col(id_col).cast("bigint")).toDF(*inner, "_leaf", "_id")
    to = leaf.select(F.struct(*LEAF).alias("_key"), F.col("full").alias("_full"), F.col("cutoff").alias("_cutoff"))
    times = F.col("_full") + (_spin(how.get("seed", SEED), "_full", "_id") <= F.col("_cutoff")).cast("int")
    return keyed.join(to, F.col("_leaf") == F.col("_key")).withColumn("_epoch", F.explode(F.when(times > 0, F.sequence(F.lit(1), times)))).select(*inner).toDF(*names)


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Epochs of all documents under the default weights: see mix."""
    return mix(table(spark, sf_dir, "documents"))


def _case(column: str, weights: Mapping[str, int]) -> str:
    listed = " ".join(f"when '{k}' then {v}" for k, v in weights.items())
    return f"cast(case {column} {listed} else 1 end as bigint)"


def _fill_sql(child: str, parent: str, name: str, out: str) -> str:
    by = f"partition by {parent}" if parent else ""
    before = f"over ({by} order by cap / weight, {name} rows between unbounded preceding and 1 preceding)"
    return f"""
{out}_a as (select *, cap / weight as r, (budget - coalesce(sum(cap) {before}, 0)) / (sum(weight) over ({by}) - coalesce(sum(weight) {before}, 0)) as lev from {child}),
{out}_b as (select *, min(case when r > lev then struct_pack(r := r, n := {name}, l := lev) end) over ({by}) as pt from {out}_a),
{out} as (select *, cast(case when r <= lev then cap else floor(pt.l * weight) end as bigint) as got from {out}_b)"""


SQL = rf"""
with d as (select doc_id, coalesce(lang, '') as lang, coalesce(source, '') as source,
    len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as n_tokens from documents),
t as (select *, 'd' || cast((instr('0123456789abcdef', substr(md5(source), 1, 1)) - 1) // 4 as varchar) as domain from d),
leaf as (select domain, lang, source, cast(sum(n_tokens) as bigint) as tokens from t group by all),
c1 as (select domain, cast(sum(tokens) * {MAX_EPOCHS} as bigint) as cap, {_case("domain", DOMAIN_WEIGHTS)} as weight,
  (select cast(sum(tokens) as bigint) from leaf) as budget from leaf group by domain),
{_fill_sql("c1", "", "domain", "f1")},
c2 as (select leaf.domain, lang, cast(sum(tokens) * {MAX_EPOCHS} as bigint) as cap, {_case("lang", LANG_WEIGHTS)} as weight, any_value(f1.got) as budget
  from leaf join f1 on leaf.domain = f1.domain group by leaf.domain, lang),
{_fill_sql("c2", "domain", "lang", "f2")},
c3 as (select leaf.domain, leaf.lang, source, tokens, tokens * {MAX_EPOCHS} as cap, {_case("source", SOURCE_WEIGHTS)} as weight, f2.got as budget
  from leaf join f2 on leaf.domain = f2.domain and leaf.lang = f2.lang),
{_fill_sql("c3", "domain, lang", "source", "f3")},
l as (select domain, lang, source, got as target, case when tokens = 0 then 1 else got // tokens end as full_epochs,
  case when tokens = 0 then 0 else got % tokens end as rest from f3),
p as (select t.*, target, full_epochs, rest, md5('{SEED}|' || cast(full_epochs as varchar) || '|' || coalesce(cast(doc_id as varchar), '')) as spin
  from t join l on t.domain = l.domain and t.lang = l.lang and t.source = l.source)
select doc_id, domain, lang, source, cast(n_tokens as bigint) as n_tokens, target,
  cast(full_epochs + case when sum(n_tokens) over (partition by domain, lang, source order by spin range unbounded preceding) <= rest then 1 else 0 end as bigint) as epochs
from p
"""
