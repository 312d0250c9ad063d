"""Segmentation of meshes and point graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def face_normals(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """(scan_id, face_id, v1, v2, v3, nx, ny, nz): unit normals of triangles; vertices(scan_id, vertex_id, x, y, z)."""
    f = faces
    for k in (1, 2, 3):
        f = f.join(vertices.select("scan_id", F.col("vertex_id").alias(f"v{k}"), *[F.col(a).alias(f"{a}{k}") for a in "xyz"]), ["scan_id", f"v{k}"])
    u, v = [[F.col(f"{a}{k}") - F.col(f"{a}1") for a in "xyz"] for k in (2, 3)]
    n = [u[1] * v[2] - u[2] * v[1], u[2] * v[0] - u[0] * v[2], u[0] * v[1] - u[1] * v[0]]
    size = F.sqrt(n[0] * n[0] + n[1] * n[1] + n[2] * n[2])
    return f.select("scan_id", "face_id", "v1", "v2", "v3", *[F.coalesce(F.try_divide(c, size), F.lit(0.0)).alias("n" + a) for c, a in zip(n, "xyz")])


def vertex_normals(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """Mean face normal of each vertex."""
    n = face_normals(vertices, faces)
    return n.select("scan_id", F.explode(F.array("v1", "v2", "v3")).alias("vertex_id"), "nx", "ny", "nz").groupBy("scan_id", "vertex_id").agg(*[F.avg("n" + a).alias("n" + a) for a in "xyz"])


def edge_weights(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(scan_id, a, b, w): 1 minus the normals' product, squared on convex edges; nodes(scan_id, node, x, y, z, nx, ny, nz)."""
    for side in "ab":
        edges = edges.join(nodes.select("scan_id", F.col("node").alias(side), *[F.col(c).alias(c + side) for c in ("x", "y", "z", "nx", "ny", "nz")]), ["scan_id", side])
    d = [F.col(c + "b") - F.col(c + "a") for c in "xyz"]
    size = F.sqrt(sum(c * c for c in d))
    product = sum(F.col(f"n{c}a") * F.col(f"n{c}b") for c in "xyz")
    convex = F.coalesce(F.try_divide(sum(F.col(f"n{c}b") * x for c, x in zip("xyz", d)), size), F.lit(0.0)) > 0
    w = 1 - product
    return edges.select("scan_id", "a", "b", F.round(F.when(convex, w * w).otherwise(w), 6).alias("w"))


def segment(edges: DataFrame, threshold: float = 0.01, least: int = 20, key: str = "bigint") -> DataFrame:
    """(scan_id, node, segment): edges by rising weight join two segments if no heavier than both allow; then small segments join a neighbour.

    A segment allows its heaviest edge plus threshold over its size. Each join hangs on all before it, so a scan is one task's.
    """
    import numpy as np
    import pandas as pd

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["w", "a", "b"], kind="stable")
        names, at = np.unique(np.concatenate([pdf["a"], pdf["b"]]), return_inverse=True)
        a, b = at[: len(pdf)].tolist(), at[len(pdf) :].tolist()
        up, size, allowed = list(range(len(names))), [1] * len(names), [threshold] * len(names)

        def root(i: int) -> int:
            while up[i] != i:
                up[i] = up[up[i]]
                i = up[i]
            return i

        def join(i: int, j: int) -> int:
            i, j = min(i, j), max(i, j)
            up[j] = i
            size[i] += size[j]
            return i

        for i, j, w in zip(a, b, pdf["w"].tolist()):
            i, j = root(i), root(j)
            if i != j and w <= allowed[i] and w <= allowed[j]:
                k = join(i, j)
                allowed[k] = w + threshold / size[k]
        for i, j in zip(a, b):
            i, j = root(i), root(j)
            if i != j and (size[i] < least or size[j] < least):
                join(i, j)
        return pd.DataFrame({"scan_id": pdf["scan_id"].iloc[0], "node": names, "segment": names[[root(i) for i in range(len(names))]]})

    scan = dict(edges.dtypes)["scan_id"]
    return edges.select("scan_id", "a", "b", "w").groupBy("scan_id").applyInPandas(run, f"scan_id {scan}, node {key}, segment {key}")
