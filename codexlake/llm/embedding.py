"""Embedding near-duplicates: int8 tile products with error bounds, exact recomputation near the threshold."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, with_columns_of
from .graph import components

#: Vectors to a tile, pairs recomputed at once, and dimensions whose int8 products float32 sums exactly.
TILE, PAIRS, EXACT = 1024, 1 << 16, 1024


def embedding_dedup(vectors: DataFrame, threshold: float = 0.93, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` for every row of ``vectors``.

    Vectors of one label and dimension are linked when their cosine in double precision is at least
    ``threshold``.  Each label is dealt into tiles of about TILE vectors, however many it has, and every
    pair of tiles is one group of rows, so a label of ``m`` vectors is sent ``m / TILE`` times: as int8 codes,
    an eighth of the vectors' bytes.  A product of codes differs from the cosine by at most
    ``e_i |q_j| + e_j |q_i| + e_i e_j`` where ``e`` is a vector's own quantisation error, so it settles all pairs but those
    near the threshold; of these the vectors alone are fetched, once a tile pair, and recomputed in full
    precision.  No link is lost.  A tile pair returns counts and a spanning forest, never its links.

    * null, zero or non-finite vectors, vectors with null components, null labels: no links, own component.
    * null id: no links, component_id null, kept.
    * rows equal in id, label and vector count as one vector; each is returned.
    * empty table: empty result.  Extra columns are ignored.
    """
    scratch = Scratch(vectors.sparkSession, "embedding")
    plain = with_columns_of(vectors, id_col, vector_col, label_col).toDF("vec_id", "v", "label")
    plain = plain.withColumn("label", F.col("label").cast("string")).withColumn("v", F.col("v").cast("array<double>")).withColumn("rid", F.xxhash64("vec_id", "label", "v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    valid = plain.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & finite & F.exists("v", lambda x: x != 0))
    valid = scratch.save(valid.dropDuplicates(["rid"]).withColumn("dim", F.size("v")))
    codes = scratch.save(valid.mapInArrow(_codes, "label string, dim int, rid long, vec_id long, code binary, scale double, norm double, error double"))
    size = codes.groupBy("label", "dim").agg(F.ceil(F.count("*") / TILE).alias("tiles"))
    dealt = codes.join(size, ["label", "dim"]).withColumn("own", F.pmod("rid", F.col("tiles")))
    of = ("label", "dim", "i", "j", "own", "rid", "vec_id")
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)))
    dealt = dealt.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other")).select(*of, "code", "scale", "norm", "error")
    kind = "label string, dim int, i long, j long, own long, rid long, vec_id long, links long, root long, open boolean"
    found = scratch.save(dealt.groupBy("label", "dim", "i", "j").applyInArrow(_tile(threshold, False), kind))
    near = found.where("open").select(*of).join(valid.select("rid", "v"), "rid")
    settled = near.groupBy("label", "dim", "i", "j").applyInArrow(_tile(threshold, True), kind)
    found = scratch.save(found.where("links > 0").unionByName(settled.where("links > 0")))
    links = found.groupBy("rid").agg(F.sum("links").alias("n"))
    label = components(found.select(F.col("vec_id").alias("a"), F.col("root").alias("b")), scratch)
    out = plain.select("vec_id", "rid").join(links, "rid", "left")
    linked = F.col("n") > 0
    # an id that another row with a link also has must not lend that link to this one
    out = out.join(label, (F.col("vec_id") == F.col("node")) & linked, "left")
    component = F.coalesce("component", "vec_id")
    return out.select(
        "vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(True)).alias("kept")
    )


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of unit vectors: int8 codes, scales, norms of what the codes stand for, norms of the error."""
    scale = np.abs(x).max(axis=1) / 127
    codes = np.rint(x / scale[:, None]).astype(np.int8)
    back = codes * scale[:, None]
    up = 1 + 1e-12
    return codes, scale, np.linalg.norm(back, axis=1) * up, np.linalg.norm(x - back, axis=1) * up + 1e-15


Codes = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def candidates(x: Codes, y: Codes, same: bool, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of rows (``same``: each once) whose cosine may reach the threshold, and whether it surely does.

    A product of codes is a whole number that double precision holds, so a pair is judged alike wherever it meets.
    """
    (qa, sa, na, ea), (qb, sb, nb, eb) = x, y
    dot = np.zeros((len(qa), len(qb)))
    for d in range(0, qa.shape[1], EXACT):
        dot += qa[:, d : d + EXACT].astype(np.float32) @ qb[:, d : d + EXACT].astype(np.float32).T
    loose = ea.max() * nb.max() + eb.max() * na.max() + ea.max() * eb.max() + 1e-9
    a, b = np.nonzero(dot >= (threshold - loose) / (sa[:, None] * sb[None, :]) - 1e-3)
    if same:
        a, b = a[a < b], b[a < b]
    value = dot[a, b] * (sa[a] * sb[b])
    bound = ea[a] * nb[b] + eb[b] * na[a] + ea[a] * eb[b] + 1e-9
    may = value + bound >= threshold
    return a[may], b[may], (value - bound >= threshold)[may]


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def _codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        v, dims = batch.column("v"), batch.column("dim").to_numpy()
        for dim in np.unique(dims).tolist():
            at = np.flatnonzero(dims == dim)
            q, scale, norm, error = quantise(_unit(v.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)))
            some = batch.select(["label", "dim", "rid", "vec_id"]).take(pa.array(at))
            yield pa.RecordBatch.from_arrays([some.column("label"), *some.columns[1:], pa.array([c.tobytes() for c in q], pa.binary()), pa.array(scale), pa.array(norm), pa.array(error)], ["label", "dim", "rid", "vec_id", "code", "scale", "norm", "error"])


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of each of ``n`` nodes the smallest it reaches over the links ``a - b``."""
    low = np.arange(n)
    while len(a):
        m = np.minimum(low[a], low[b])
        np.minimum.at(low, a, m)
        np.minimum.at(low, b, m)
        low = low[low]
        stay = low[a] != low[b]
        if not stay.any():
            break
        # hook roots onto roots, so that whole trees meet
        x, y = low[a[stay]], low[b[stay]]
        np.minimum.at(low, np.maximum(x, y), np.minimum(x, y))
        low = low[low]
    while (low != low[low]).any():
        low = low[low]
    return low


def _tile(threshold: float, exact: bool):
    """One pair of tiles: links of the pairs that codes settle, and which vectors have others; or, of those vectors, the links of the others."""

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        own, i = table.column("own").to_numpy(), table.column("i")[0].as_py()
        dim, same = table.column("dim")[0].as_py(), i == table.column("j")[0].as_py()
        order = np.argsort(own != i, kind="stable")
        n = len(order)
        first = n if same else int((own == i).sum())
        unit = None
        if exact:
            unit = _unit(np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in table.column("v").chunks]).reshape(-1, dim)[order])
            every = quantise(unit)
        else:
            flat = np.frombuffer(b"".join(table.column("code").to_pylist()), np.int8).reshape(-1, dim)
            every = (flat[order], *(table.column(c).to_numpy()[order] for c in ("scale", "norm", "error")))
        links, root, open_ = np.zeros(n, np.int64), np.arange(n), np.zeros(n, bool)
        if first and (same or first < n):
            sides = every if same else tuple(x[:first] for x in every), every if same else tuple(x[first:] for x in every)
            a, b, sure = candidates(*sides, same, threshold)
            b = b if same else b + first
            if exact:
                a, b = a[~sure], b[~sure]
                ok = np.concatenate([np.einsum("ij,ij->i", unit[a[k : k + PAIRS]], unit[b[k : k + PAIRS]]) >= threshold for k in range(0, len(a), PAIRS)] or [np.empty(0, bool)])
                a, b = a[ok], b[ok]
            else:
                open_[a[~sure]] = open_[b[~sure]] = True
                a, b = a[sure], b[sure]
            links = np.bincount(a, minlength=n) + np.bincount(b, minlength=n)
            root = forest(n, a, b)
        hit = (links > 0) | open_
        out = table.select(["label", "dim", "i", "j", "own", "rid", "vec_id"]).take(pa.array(order[hit]))
        vec = table.column("vec_id").to_numpy()[order]
        for name, values in (("links", links[hit]), ("root", vec[root][hit]), ("open", open_[hit])):
            out = out.append_column(name, pa.array(values))
        return out

    return run
