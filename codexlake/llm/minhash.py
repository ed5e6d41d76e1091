"""MinHash near-duplicate detection: fast similarity sketches, banding, exact verification."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import minhash_core as core
from .common import Scratch, lists, row_slices, starts_of, with_columns_of
from .graph import components

#: Coordinates of a sketch, and how likely a pair at the threshold may share no band.
COORDINATES, MISS = 360, 1e-5
#: Documents to a tile where a band is compared pair by pair.
TILE = 256


def band_rows(percent: int) -> int:
    """Coordinates to a band: as many as keep a pair at the threshold from being missed (0.85: 8, a miss in 6e-7; 0.8: 7, 6e-6)."""
    s = percent / 100
    return max((r for r in range(1, 21) if (1 - s**r) ** (COORDINATES // r) <= MISS), default=1)


def minhash_dedup(docs: DataFrame, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Near-duplicate groups of ``docs``: ``(doc_id, n_shingles, component_id, kept)``, a row per row of docs.

    Two documents are linked when ``100 * |A & B| >= percent * |A | B|`` over their sets of 64-bit word
    5-shingle hashes.  Equal sets are one class; a band's classes are first compared with its smallest
    class, and where that leaves more than one component in a band, tile by tile with each other, so
    no candidate pair is left out.  A miss needs a linked pair that agrees on no band at all.

    * null or word-less text: n_shingles 0, its own component, kept.
    * null id: linked with nothing, component_id null, kept.
    * rows that repeat an id: each row is returned with the component of its own text's class; an id stands for
      all of its texts in the links, so an id with several texts brings their groups together.
    * empty table: empty result.  Extra columns of ``docs`` are ignored.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "minhash")
    plain = with_columns_of(docs, id_col, text_col).toDF("doc_id", "text")
    signed = scratch.save(plain.mapInArrow(_sign(band_rows(percent)), "doc_id long, n_shingles long, digest binary, bands array<long>"))

    classes = scratch.save(
        signed.where("doc_id is not null and n_shingles > 0")
        .groupBy("digest")
        .agg(F.min(F.struct("doc_id", "n_shingles", "bands")).alias("r"))
        .select("digest", F.col("r.doc_id").alias("rep"), F.col("r.n_shingles").alias("n"), F.col("r.bands").alias("bands"))
    )
    edges = _links(spark, plain, classes, percent, scratch)
    label = components(edges, scratch)
    named = classes.select("digest", "rep").join(label, F.col("rep") == F.col("node"), "left").select("digest", F.coalesce("component", "rep").alias("of"))
    out = signed.select("doc_id", "n_shingles", "digest").join(named, "digest", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("of", "doc_id"))
    return out.select(
        "doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept")
    )


def _links(spark: SparkSession, plain: DataFrame, classes: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    member = classes.select("rep", "n", F.explode("bands").alias("band"))
    # written first, so that both sides of the join are read by their own exchange and a hot band's partition can be split
    shared = scratch.save(member.groupBy("band").agg(F.count("*").alias("m"), F.min("rep").alias("pivot")).where("m > 1"))
    member = scratch.save(member.join(shared, "band"))

    # 1. every class of a band against the band's smallest
    star = scratch.save(member.where("rep <> pivot").select(F.col("pivot").alias("a"), F.col("rep").alias("b")).distinct())
    wanted = star.select(F.explode(F.array("a", "b")).alias("doc_id"))
    wanted = wanted.union(member.where("m > 2").select("rep")).distinct()
    # the sets of candidates alone are made again from whole texts; a class's smallest id stands for it
    sets = scratch.save(
        plain.where("doc_id is not null").join(wanted, "doc_id", "left_semi").mapInArrow(_sets, "doc_id long, items binary")
    )
    left = sets.select(F.col("doc_id").alias("a"), F.col("items").alias("x"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("items").alias("y"))
    found = scratch.save(star.join(left, "a").join(right, "b").mapInArrow(_verify(percent), "a long, b long"))

    # 2. bands in which other classes than the pivot's still lie in different components
    label = scratch.save(components(found, scratch))
    known = member.where("m > 2").join(label, F.col("rep") == F.col("node"), "left").select("band", "m", "rep", "pivot", F.coalesce("component", "rep").alias("of"))
    rest = known.where("rep <> pivot")
    # of each such band its largest component there; only the other classes have to meet it, and each other
    size = rest.groupBy("band", "of").agg(F.count("*").alias("c")).groupBy("band")
    size = size.agg(F.max_by("of", F.struct("c", "of")).alias("main"), F.max("c").alias("big"), (F.sum("c") - F.max("c")).alias("others"))
    # written first, like the bands above
    open_ = scratch.save(size.where("others > 0").select("band", "main", F.ceil(F.col("big") / TILE).alias("wide"), F.ceil(F.col("others") / TILE).alias("tiles")))
    tiled = rest.join(open_, "band").select("rep", "of", "band", "wide", "tiles", (F.col("of") == F.col("main")).alias("is_main"))
    return found.union(_dealt(tiled).join(sets, F.col("rep") == F.col("doc_id")).groupBy("band", "i", "j").applyInArrow(_tile(percent), "a long, b long"))


def _dealt(rows: DataFrame) -> DataFrame:
    """``(band, i, j, rep, of)``: classes dealt to pairs of tiles, so that any two of different components meet, and no two of the largest have to.

    A tile of other classes (``i``) meets every tile of the largest component (``j`` below 0) and of other
    classes (``j`` from ``i`` on): the largest is sent as often as there are tiles of others.
    """
    own = F.pmod(F.xxhash64("rep"), F.when(F.col("is_main"), F.col("wide")).otherwise(F.col("tiles")))
    rows = rows.withColumn("own", own)
    upto = lambda n: F.sequence(F.lit(0).cast("long"), F.col(n) - 1)
    pair = lambda i, j: F.struct(i.alias("i"), j.alias("j"))
    main = F.transform(upto("tiles"), lambda k: pair(k, -1 - F.col("own")))
    other = F.concat(F.transform(upto("wide"), lambda k: pair(F.col("own"), -1 - k)), F.transform(upto("tiles"), lambda k: pair(F.least(k, F.col("own")), F.greatest(k, F.col("own")))))
    return rows.select("band", "rep", "of", F.explode(F.when(F.col("is_main"), main).otherwise(other)).alias("p")).select("band", "p.i", "p.j", "rep", "of")


def _sign(rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in row_slices(batch, "text"):
                sets = [core.shingle_set(t) for t in part.column("text").to_pylist()]
                full = [k for k, s in enumerate(sets) if len(s)]
                keys = np.empty((0, COORDINATES // rows), np.uint64)
                if full:
                    starts = starts_of(len(sets[k]) for k in full)
                    keys = core.bands(core.sketch(np.concatenate([sets[k] for k in full]), starts, COORDINATES), rows)
                width = np.zeros(len(sets), np.int64)
                width[full] = keys.shape[1]
                digest = [core.xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(digest, pa.binary()),
                     lists(keys.reshape(-1).view(np.int64), starts_of(width), pa.int64())],
                    ["doc_id", "n_shingles", "digest", "bands"],
                )

    return run


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in row_slices(batch, "text"):
            items = [core.shingle_set(t).tobytes() for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(items, pa.binary())], ["doc_id", "items"])


def _verify(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, x, y = (batch.column(n) for n in ("a", "b", "x", "y"))
            ok = np.fromiter(
                (core.linked(np.frombuffer(p.as_buffer(), np.uint64), np.frombuffer(q.as_buffer(), np.uint64), percent) for p, q in zip(x, y, strict=True)),
                bool, len(x),
            )
            yield pa.RecordBatch.from_arrays([a, b], ["a", "b"]).filter(pa.array(ok))

    return run


def _tile(percent: int):
    def run(table: pa.Table) -> pa.Table:
        rep, of = table.column("rep").to_numpy(), table.column("of").to_numpy()
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("items")]
        a, b = core.links_between(sets, of, percent)
        return pa.table({"a": rep[a], "b": rep[b]}, schema=pa.schema([("a", pa.int64()), ("b", pa.int64())]))

    return run
