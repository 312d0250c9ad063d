"""Near-duplicates among embeddings by a robust-pruned flat graph.

Vectors of a label are dealt to overlapping cluster shards. In each shard a graph is built whose
lists are pruned so that no neighbour is much nearer to another one; the lists that a vector has from several shards
are united. A search starts from the shard's medoid, goes greedily towards its query, and once in
range expands everything in range. What it finds is verified in double precision.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stemline.llm.common import checkpoint, table
from stemline.llm.components import connected_components
from stemline.llm.simhash import Forest

#: Cosine of a link.
THRESHOLD = 0.93
#: Vectors for each pivot, pivots in all (64 doubles each: 10 MB), and how much less similar than the nearest a pivot may be to hold a vector too.
SHARD, PIVOTS, MARGIN = 1000, 20_000, 0.12
#: Graph: longest list, candidates for it, far candidates, slack of the pruning.
DEGREE, POOL, FAR, ALPHA = 32, 64, 6, 1.2
#: Vectors of a cell, within which lists are made.
CELL = 1000
#: Pivots that share a shard if they are this near to the first of them, so many at most: a dense cluster is one shard of GROUP * SHARD vectors.
NEAR, GROUP = 0.75, 24
#: Search: beam, how far below the threshold a vector is still expanded, and vectors met (or a sixteenth of the shard, if that is more) from which a query is compared with all.
BEAM, SLACK, DENSE = 32, 0.2, 1500
#: What is done side by side: places of a beam, and places in range, from which a query goes on in a round; marks of vectors met by queries; longest list whose distances are all worked out.
AT_ONCE, IN_RANGE, MARKS, WIDE = 4, 16, 1 << 22, 2000


def unit_rows(vectors: list | np.ndarray) -> np.ndarray:
    x = np.array(vectors, np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def rows_of(vectors: pa.ListArray) -> np.ndarray:
    """Vectors of one dimension, none of them null."""
    return vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(vectors), -1)


def robust_prune(distance: np.ndarray, between: Callable[[np.ndarray, int], np.ndarray]) -> np.ndarray:
    """Which candidates are kept, a row of them for each vector: each that no kept one is ALPHA times nearer to, up to DEGREE.

    Distances are squared and sorted, infinite where there is no candidate; between(rows, k) gives those of the rows' k-th candidates to the ones behind.
    """
    alive, kept = np.isfinite(distance), np.zeros(distance.shape, bool)
    left = np.full(len(distance), DEGREE)
    for k in range(distance.shape[1]):
        rows = np.flatnonzero(alive[:, k] & (left > 0))
        kept[rows, k] = True
        left[rows] -= 1
        alive[rows, k + 1 :] &= ALPHA**2 * between(rows, k) > distance[rows, k + 1 :]
    return kept


def dots(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """x[a] times x[b], row by row."""
    out = np.empty(len(a))
    for k in range(0, len(a), 4096):
        np.einsum("ij,ij->i", x[a[k : k + 4096]], x[b[k : k + 4096]], out=out[k : k + 4096])
    return out


def _cells(x: np.ndarray, rng: np.random.Generator) -> Iterator[np.ndarray]:
    """Overlapping clusters of CELL vectors, about: each vector is in those of the two sampled ones that are nearest."""
    n = len(x)
    if n <= 2 * CELL:
        yield np.arange(n)
        return
    pivots = x[rng.choice(n, -(-2 * n // CELL), replace=False)]
    two = np.concatenate([np.argpartition(-(x[a : a + 1024] @ pivots.T), 1, axis=1)[:, :2] for a in range(0, n, 1024)])
    member = np.repeat(np.arange(n), 2)
    order = np.argsort(two.ravel(), kind="stable")
    for some in np.split(member[order], np.flatnonzero(np.diff(two.ravel()[order])) + 1):
        for part in np.array_split(rng.permutation(some), -(-len(some) // (2 * CELL))):  # what many are nearest to is cut
            yield np.sort(part)


def build_graph(x: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(where lists begin, neighbours) of the unit vectors x, found cell by cell, pruned, united and made mutual; the work grows with len(x) * CELL."""
    n = len(x)
    rng = np.random.default_rng(seed)
    edges = [np.empty(0, np.int64)]
    for cell in _cells(x, rng):
        m, y = len(cell), x[cell]
        pool = min(POOL, m - 1)
        if pool < 1:
            continue
        apart = y @ y.T
        apart *= -2
        apart += 2
        np.maximum(apart, 0, out=apart)
        np.fill_diagonal(apart, np.inf)
        top = np.concatenate([np.argpartition(apart[a : a + 256], pool - 1, axis=1)[:, :pool] for a in range(0, m, 256)])
        c = np.sort(np.concatenate([top, rng.integers(0, m, (m, FAR))], axis=1), axis=1)
        d = np.take_along_axis(apart, c, axis=1)
        d[:, 1:][c[:, 1:] == c[:, :-1]] = np.inf
        order = np.argsort(d, axis=1, kind="stable")
        c, d = np.take_along_axis(c, order, axis=1), np.take_along_axis(d, order, axis=1)
        i, k = np.nonzero(robust_prune(d, lambda rows, k, apart=apart, c=c: apart[c[rows, k, None], c[rows, k + 1 :]]))
        edges.append(cell[i] * n + cell[c[i, k]])
    edge = np.concatenate(edges)
    edge = np.unique(np.concatenate([edge, edge % max(n, 1) * n + edge // max(n, 1)]))
    of, near = np.divmod(edge, max(n, 1))
    size = np.bincount(of, minlength=n)
    start, stay = np.cumsum(size) - size, np.ones(len(near), bool)
    long = np.flatnonzero(size > 2 * DEGREE)
    long = long[np.argsort(-size[long], kind="stable")]
    a = 0
    while a < len(long):
        width = int(size[long[a]])
        some = long[a : a + max(1, WIDE**2 // width**2)]
        a += len(some)
        there = np.arange(width) < size[some, None]
        at = np.where(there, start[some, None] + np.arange(width), start[some, None])
        y = x[near[at]]
        d = np.where(there, np.maximum(0, 2 - 2 * (y @ x[some][:, :, None])[:, :, 0]), np.inf)
        order = np.argsort(d, axis=1, kind="stable")
        at, d, y = np.take_along_axis(at, order, axis=1), np.take_along_axis(d, order, axis=1), np.take_along_axis(y, order[:, :, None], axis=1)
        if width <= WIDE:
            apart = 2 - 2 * (y @ y.transpose(0, 2, 1))
            kept = robust_prune(d, lambda rows, k, apart=apart: apart[rows, k, k + 1 :])
        else:  # what very many are near to, row by row
            kept = robust_prune(d, lambda rows, k, y=y: 2 - 2 * (y[rows, k + 1 :] @ y[rows, k][:, :, None])[:, :, 0])
        stay[at[np.isfinite(d) & ~kept]] = False
    return np.concatenate([[0], np.cumsum(np.bincount(of[stay], minlength=n))]), near[stay]


def _range_search(x: np.ndarray, begin: np.ndarray, near: np.ndarray, medoid: int, asked: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """range_search of a few queries, side by side: each round a query goes on from IN_RANGE of those it has met in range or, if there are none, from the best of its beam."""
    n, r, size = len(x), len(asked), np.diff(begin)
    floor, most = threshold - SLACK, max(DENSE, n // 16)
    rows = np.arange(r)
    seen, last = np.zeros(r * n, bool), np.empty(r * n, np.int32)
    seen[rows * n + medoid] = seen[rows * n + asked] = True
    start = dots(x, asked, np.full(r, medoid))
    hit = (start >= threshold - 1e-9) & (asked != medoid)
    of, hits = [rows[hit]], [np.full(hit.sum(), medoid)]
    met, least = np.full(r, 2), np.full(r, -np.inf)
    beam, sims, new, fresh = rows, start, np.full(r, medoid), np.zeros(r, bool)  # of all queries, by query and from the best on; fresh: not gone on from
    row, node = np.tile(rows, 2), np.concatenate([asked, new])
    later, wait = np.empty(0, np.int64), np.empty(0, np.int64)  # met in range, by query
    while len(row):
        count = size[node]
        flat = np.arange(count.sum()) + np.repeat(begin[node] - (np.cumsum(count) - count), count)
        row, node = np.repeat(row, count), near[flat]
        key = row * n + node
        some = np.flatnonzero(~seen[key])
        key = key[some]
        last[key] = np.arange(len(key), dtype=np.int32)
        one = last[key] == np.arange(len(key), dtype=np.int32)  # met twice in a round
        seen[key] = True
        row, node = row[some[one]], node[some[one]]
        met += np.bincount(row, minlength=r)
        going = met <= most
        row, node = row[going[row]], node[going[row]]
        s = dots(x, asked[row], node)
        hit, inside = s >= threshold - 1e-9, s >= floor
        of.append(row[hit])
        hits.append(node[hit])
        stay, better = going[beam], ~inside & (s > least[row])
        beam, sims, new = np.concatenate([beam[stay], row[better]]), np.concatenate([sims[stay], s[better]]), np.concatenate([new[stay], node[better]])
        fresh = np.concatenate([fresh[stay], np.ones(better.sum(), bool)])
        order = np.argsort(beam + (1 - sims) / 4)
        beam, sims, new, fresh = beam[order], sims[order], new[order], fresh[order]
        many = np.bincount(beam, minlength=r)
        rank = np.arange(len(beam)) - np.repeat(np.cumsum(many) - many, many)
        least[beam[rank == BEAM - 1]] = sims[rank == BEAM - 1]
        stay = rank < BEAM
        beam, sims, new, fresh = beam[stay], sims[stay], new[stay], fresh[stay]
        many, upto = np.bincount(beam, minlength=r), np.cumsum(fresh)
        before = np.concatenate([[0], upto])[np.cumsum(many) - many]
        stay = going[later]
        row, node = np.concatenate([later[stay], row[inside]]), np.concatenate([wait[stay], node[inside]])
        order = np.argsort(row, kind="stable")
        row, node = row[order], node[order]
        some = np.bincount(row, minlength=r)
        now = np.arange(len(row)) - np.repeat(np.cumsum(some) - some, some) < IN_RANGE
        later, wait, row, node = row[~now], node[~now], row[now], node[now]
        go = fresh & (upto - np.repeat(before, many) <= AT_ONCE) & (np.bincount(row, minlength=r) == 0)[beam]
        fresh = fresh & ~go
        row, node = np.concatenate([row, beam[go]]), np.concatenate([node, new[go]])
    of, hits = np.concatenate(of), np.concatenate(hits)
    done = met <= most
    return asked[of[done[of]]], hits[done[of]], asked[~done]


def range_search(x: np.ndarray, begin: np.ndarray, near: np.ndarray, medoid: int, asked: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, place) of vectors whose cosine with x[query] reaches the threshold, the query left out, for all that are asked; and the queries that meet so many vectors that comparing all is less work."""
    step = max(1, MARKS // max(1, len(x)))
    parts = [_range_search(x, begin, near, medoid, asked[a : a + step], threshold) for a in range(0, len(asked), step)]
    return tuple(np.concatenate([p[k] for p in parts]) if parts else np.empty(0, np.int64) for k in range(3))


def cosine_at_least(x: np.ndarray, y: np.ndarray, threshold: float) -> np.ndarray:
    """Row by row in double precision, from the vectors as they are."""
    return np.einsum("ij,ij->i", x, y) / (np.linalg.norm(x, axis=1) * np.linalg.norm(y, axis=1)) >= threshold


def _classes(rows: DataFrame) -> DataFrame:
    """(label, vector, class_id, members): equal vectors of a label are one class, named by its smallest id."""
    return rows.where("usable").groupBy("label", "vector").agg(F.min("vec_id").alias("class_id"), F.count(F.lit(1)).alias("members"))


def _shards(classes: DataFrame) -> DataFrame:
    """classes with a row for each shard that holds them: shard, home (is it the nearest pivot's?)."""
    spark = classes.sparkSession
    sizes = classes.groupBy("label", F.size("vector").alias("dim")).count().collect()  # a row a label
    total = sum(r["count"] for r in sizes)
    each = max(SHARD, total // PIVOTS + 1)
    share = {(r["label"], r["dim"]): -(-r["count"] // each) / r["count"] for r in sizes}
    listed = spark.createDataFrame([(lab, dim, float(s)) for (lab, dim), s in share.items()], "p_label string, p_dim int, share double")
    spin = F.pmod(F.xxhash64("class_id"), F.lit(1 << 40)) / float(1 << 40)
    picked = classes.join(F.broadcast(listed), (F.col("label") == F.col("p_label")) & (F.size("vector") == F.col("p_dim"))).where(spin < F.col("share"))
    pivots: dict[tuple, list] = {}
    for r in picked.select("label", "vector", "class_id").orderBy("class_id").limit(2 * PIVOTS).collect():
        pivots.setdefault((r["label"], len(r["vector"])), []).append(r["vector"])
    units = {k: unit_rows(v) for k, v in pivots.items() if len(v) > 1}
    shared = spark.sparkContext.broadcast({k: (v, _grouped(v)) for k, v in units.items()})
    number = {k: i for i, k in enumerate(sorted(share))}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            labels, vectors = batch["label"].to_pylist(), batch["vector"]
            row, shard, home = [], [], []
            groups: dict[tuple, list[int]] = {}
            for i, key in enumerate(zip(labels, vectors.value_lengths().to_pylist())):
                groups.setdefault(key, []).append(i)
            for key, at in groups.items():
                base = number[key] << 32
                if key not in known:
                    row += at
                    shard += [base] * len(at)
                    home += [True] * len(at)
                    continue
                units, group = known[key]
                for k in range(0, len(at), 256):
                    some = at[k : k + 256]
                    sims = unit_rows(rows_of(vectors.take(pa.array(some, pa.int64())))) @ units.T
                    best = group[sims.argmax(axis=1)]
                    a, b = np.nonzero(sims >= sims.max(axis=1, keepdims=True) - MARGIN)
                    a, b = np.divmod(np.unique(a * len(group) + group[b]), len(group))
                    row += [some[i] for i in a.tolist()]
                    shard += (b + base).tolist()
                    home += (b == best[a]).tolist()
            part = batch.take(pa.array(row, pa.int64()))
            yield pa.RecordBatch.from_arrays([part["vector"], part["class_id"], part["members"], pa.array(shard, pa.int64()), pa.array(home, pa.bool_())], names=["vector", "class_id", "members", "shard", "home"])

    kind = classes.schema["vector"].dataType.simpleString()
    return classes.select("label", "vector", "class_id", "members").mapInArrow(run, f"vector {kind}, class_id bigint, members bigint, shard bigint, home boolean")


def _grouped(units: np.ndarray) -> np.ndarray:
    """For each pivot the first one of its group: the nearest such that is near enough and has room. Pivots of a dense cluster are all near each
    other, and a vector near to all of them; dealt to each it would be in every shard."""
    group, size, leaders = np.empty(len(units), np.int64), [], []
    firsts = np.empty_like(units)
    for k, u in enumerate(units):
        if leaders:
            sims = np.where(np.array(size) < GROUP, firsts[: len(leaders)] @ u, -2)
            at = int(sims.argmax())
            if sims[at] >= NEAR:
                group[k] = leaders[at]
                size[at] += 1
                continue
        firsts[len(leaders)] = u
        group[k] = k
        leaders.append(k)
        size.append(1)
    return group


def _lists(held: DataFrame, threshold: float) -> DataFrame:
    """(class_id, near, close): the lists that a class has from all its shards, united, and those of them that a search would go on from."""

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("class_id")  # the same graph, however rows arrive
        ids, x = rows["class_id"].to_numpy(), unit_rows(rows_of(rows["vector"].combine_chunks()))
        begin, near = build_graph(x, int(rows["shard"][0].as_py()) & 0xFFFF)
        of = np.repeat(np.arange(len(ids)), np.diff(begin))
        close = dots(x, of, near) >= threshold - SLACK
        fewer = np.concatenate([[0], np.cumsum(np.bincount(of[close], minlength=len(ids)))])
        lists = [pa.ListArray.from_arrays(pa.array(b, pa.int32()), pa.array(ids[v], pa.int64())) for b, v in ((begin, near), (fewer, near[close]))]
        return pa.table({"class_id": ids, "near": lists[0], "close": lists[1]})

    lists = held.select("shard", "class_id", "vector").groupBy("shard").applyInArrow(run, "class_id bigint, near array<bigint>, close array<bigint>")
    united = [F.array_distinct(F.flatten(F.collect_list(c))).alias(c) for c in ("near", "close")]
    return lists.groupBy("class_id").agg(*united)


def links(classes: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(class_id, others, root): for each class the vectors in other classes that it links with, and links that join what is linked.

    A class is searched for once, in its home shard, over the members of the shard and
    the halo: neighbours in the united lists of its members, dealt elsewhere, that are near enough for a search to go on from them. Rows with others null only carry a link.
    """
    held = checkpoint(_shards(classes))
    lists = checkpoint(_lists(held, threshold))
    seats = held.select("shard", "class_id", "home")
    near = seats.join(lists, "class_id").select("shard", F.explode("close").alias("class_id")).distinct()
    halo = near.join(seats.select("shard", "class_id"), ["shard", "class_id"], "left_anti").withColumn("home", F.lit(False))
    every = seats.withColumn("member", F.lit(True)).unionByName(halo.withColumn("member", F.lit(False)))
    graph = every.join(lists.drop("close"), "class_id").join(classes.select("class_id", "vector", "members"), "class_id")

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("class_id")
        ids, weight = rows["class_id"].to_numpy(), rows["members"].to_numpy()
        raw = rows_of(rows["vector"].combine_chunks())
        x = unit_rows(raw)
        lists_ = rows["near"].combine_chunks()
        flat, of = lists_.flatten().to_numpy(), np.repeat(np.arange(len(ids)), lists_.value_lengths().to_numpy())
        at = np.minimum(np.searchsorted(ids, flat), len(ids) - 1)
        here = ids[at] == flat
        begin = np.concatenate([[0], np.cumsum(np.bincount(of[here], minlength=len(ids)))])
        member = rows["member"].to_numpy(zero_copy_only=False)
        medoid = int(np.argmax(np.where(member, x @ x[member].mean(axis=0), -2)))
        forest, asked = Forest(len(ids)), np.flatnonzero(rows["home"].to_numpy(zero_copy_only=False))
        q, hit, dense = range_search(x, begin, at[here], medoid, asked, threshold)
        found = []
        for a in range(0, len(q), 4096):
            some, other = q[a : a + 4096], hit[a : a + 4096]
            true = cosine_at_least(raw[other], raw[some], threshold)
            found.append(other[true] * len(ids) + some[true])
            for i, j in zip(some[true].tolist(), other[true].tolist()):
                forest.join(i, j)
        roots, links_ = np.array([forest.root(i) for i in range(len(ids))], np.int64), {}
        sparse = np.setdiff1d(asked, dense)
        for a in range(0, len(dense), 128):  # queries whose links are a good part of the shard: against all, in blocks
            some = dense[a : a + 128]
            sims = x[some] @ x.T
            hit = sims >= threshold
            i, j = np.nonzero(np.abs(sims - threshold) < 1e-9)
            hit[i, j] = cosine_at_least(raw[some[i]], raw[j], threshold)
            hit[np.arange(len(some)), some] = False
            links_.update(zip(some.tolist(), (hit @ weight).tolist()))
            i, j = np.nonzero(hit[:, sparse])
            found.append(sparse[j] * len(ids) + some[i])
            for q, h in zip(some.tolist(), hit):
                met = roots[h]
                if (met != roots[q]).any():
                    met = np.unique(np.append(met, roots[q]))
                    roots[np.isin(roots, met)] = met[0]
        # what one of two searches finds counts for both
        pairs = np.concatenate(found) if found else np.empty(0, np.int64)
        pairs = np.unique(np.concatenate([pairs, pairs % len(ids) * len(ids) + pairs // len(ids)]))
        total = np.bincount(pairs % len(ids), weights=weight[pairs // len(ids)], minlength=len(ids)).astype(np.int64)
        others = dict(zip(asked.tolist(), total[asked].tolist())) | links_
        roots = roots.tolist()
        some = [i for i in range(len(ids)) if i in others or roots[i] != i]
        return pa.table({"class_id": ids[some], "others": pa.array([None if i not in others else int(others[i]) for i in some], pa.int64()), "root": ids[[roots[i] for i in some]] if some else ids[:0]})

    return graph.select("shard", "class_id", "vector", "members", "near", "home", "member").groupBy("shard").applyInArrow(run, "class_id bigint, others bigint, root bigint")


def embedding_groups(vectors: DataFrame, threshold: float = THRESHOLD, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each vector.

    Vectors link within a label and a dimension. Null labels and vectors that are null, empty, zero or hold
    null or non-finite components link with nothing, and neither do rows with a null id, which have no component. Equal vectors of a label are one class
    and count as links of one another. Rows that repeat an id are each returned, and link like any two. Labels may be of any
    type; other columns, whatever their names, are ignored; an empty table gives no rows.
    """
    comp = F.col("vector")
    fine = F.forall(comp, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(comp, lambda v: v != 0)
    rows = vectors.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(vector_col).alias("vector"), F.col(label_col).cast("string").alias("label"))
    rows = rows.withColumn("usable", F.coalesce(fine & F.col("label").isNotNull() & F.col("vec_id").isNotNull(), F.lit(False)))
    classes = checkpoint(_classes(rows))
    found = checkpoint(links(classes, threshold))
    groups = connected_components(found.select(F.col("class_id").alias("a"), F.col("root").alias("b")))
    counts = found.where("others is not null").groupBy("class_id").agg(F.max("others").alias("others"))
    named = classes.join(counts, "class_id", "left").join(groups, F.col("class_id") == F.col("node"), "left")
    named = named.select(F.col("label").alias("c_label"), F.col("vector").alias("c_vector"), (F.coalesce("others", F.lit(0)) + F.col("members") - 1).alias("n_links"), F.coalesce("component", "class_id").alias("component_id"))
    used = rows.where("usable").join(named, (F.col("label") == F.col("c_label")) & (F.col("vector") == F.col("c_vector"))).select("vec_id", "n_links", "component_id")
    alone = rows.where("not usable").select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    return used.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def audit(vectors: DataFrame, threshold: float = THRESHOLD) -> tuple[int, int]:
    """(links found, links there are) of the queries whose vec_id is divisible by 20, against all rows."""
    found = embedding_groups(vectors, threshold)
    got = found.where("vec_id % 20 = 0").agg(F.coalesce(F.sum("n_links"), F.lit(0))).first()[0]
    asked = vectors.where("vec_id % 20 = 0").select("vec_id", "embedding", "label").collect()
    shared = vectors.sparkSession.sparkContext.broadcast([(r["vec_id"], r["label"], r["embedding"]) for r in asked])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = 0
        for batch in batches:
            ids, labels, x = batch["vec_id"].to_pylist(), batch["label"].to_pylist(), batch["embedding"].to_pylist()
            for i, label, v in shared.value:
                at = [k for k in range(len(ids)) if labels[k] == label and ids[k] != i and x[k] is not None and v is not None and len(x[k]) == len(v)]
                if at and label is not None:
                    with np.errstate(all="ignore"):
                        n += int(cosine_at_least(np.array([x[k] for k in at], float), np.array([v] * len(at), float), threshold).sum())
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    return got, vectors.select("vec_id", "label", "embedding").mapInArrow(run, "n bigint").agg(F.sum("n")).first()[0]


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all embeddings: see embedding_groups."""
    return embedding_groups(table(spark, sf_dir, "embeddings"))


SQL = f"""
with recursive e as (select vec_id, label, list_transform(embedding, lambda x: cast(x as double)) as v from embeddings),
u as (select * from e where vec_id is not null and label is not null and len(v) > 0 and list_sum(list_transform(v, lambda x: abs(x))) > 0
  and len(list_filter(v, lambda x: x is not null and isfinite(x))) = len(v)),
l as (select a.vec_id as a, b.vec_id as b from u a join u b on a.label = b.label and a.vec_id <> b.vec_id and len(a.v) = len(b.v)
  where list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))) >= {THRESHOLD}),
r(a, b) as (select a, b from l union select r.a, l.b from r join l on r.b = l.a),
n as (select a, count(*) as n from l group by a),
c as (select a, min(b) as b from r group by a)
select vec_id, coalesce(n.n, 0) as n_links, least(vec_id, coalesce(c.b, vec_id)) as component_id, coalesce(vec_id <= coalesce(c.b, vec_id), true) as kept
from e left join n on e.vec_id = n.a left join c on e.vec_id = c.a
"""
