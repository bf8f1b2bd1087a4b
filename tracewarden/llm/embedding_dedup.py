"""Embedding near-dedup: random-hyperplane sign hashing in several tables, exact cosines, components.

Equal vectors of one label form one class and go on as its smallest id, with a count. Signs
of projections on random hyperplanes give each class one bucket in every table; the number of bits
follows the logarithm of the number of classes, so buckets stay small, and the number of tables
follows from the bits and the wanted recall at the threshold. Within a bucket all cosines
are computed in double precision. A pair counts in the first table in which it meets, so each is
counted once without ever being written out: a block gives each member its number of links and
one edge of a spanning tree. Buckets above a size are verified as pairs of parts in different
tasks. Components come from the spanning edges.

Vectors compare only when their labels are equal and not null. A vector that is null, all zero,
or holds a null or non-finite component, and one whose label or id is null, links with nothing
and stands alone; so do vectors of different lengths. A vector without an id is kept and has no
component. Ids and labels are whole numbers; what cannot be cast to one fails the query. A pair
exactly at the threshold is linked. Rows that share an id are one vector: it has the links of all
its rows. Empty tables give empty results; other columns are ignored, whatever their names are.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewarden.llm.ngram_join import settled
from tracewarden.llm.repeats import groups
from tracewarden.llm.shared import components, written

COSINE, RECALL, PART = 0.98, 0.9995, 1024


def tables_for(cosine: float, recall: float, bits: int) -> int:
    """Tables with which a pair at the threshold meets with the wanted probability."""
    agree = 1 - math.acos(cosine) / math.pi
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - agree**bits)))


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    return np.asarray(column.flatten(), dtype=np.float64).reshape(-1, size)


def signs(vectors: np.ndarray, tables: int, bits: int) -> np.ndarray:
    """The bucket of each vector in each table."""
    planes = np.random.default_rng(977 + vectors.shape[1]).standard_normal((vectors.shape[1], tables * bits))
    unit = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    on = (unit @ planes > 0).reshape(len(vectors), tables, bits)
    return on @ (np.int64(1) << np.arange(bits, dtype=np.int64))


def _hash(tables: int, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column("size").to_numpy()
            for size in np.unique(sizes):
                part = batch.filter(pa.array(sizes == size))
                found = signs(_matrix(part.column("vector"), int(size)), tables, bits)
                listed = pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1, dtype=np.int32) * tables), pa.array(found.ravel()))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("label", "size", "rep")), listed], ["label", "size", "rep", "signs"])

    return run


def near_pairs(left: np.ndarray, right: np.ndarray, cosine: float) -> np.ndarray:
    unit = lambda x: (y := x / np.abs(x).max(axis=1, keepdims=True)) / np.linalg.norm(y, axis=1, keepdims=True)
    return unit(left) @ unit(right).T >= cosine


def _verify(cosine: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups(batches, "grp"):
            blocks: dict[tuple, list[tuple]] = {}
            names = ("label", "size", "t", "sign", "i", "j", "part", "rep", "copies", "vector", "signs")
            for label, size, t, sign, i, j, *row in zip(*(table.column(c).to_pylist() for c in names)):
                blocks.setdefault((label, size, t, sign, i, j), []).append(row)
            out: list[tuple[int, int, int]] = []
            for (_, _, t, _, i, j), rows in blocks.items():
                rows.sort(key=lambda x: (x[0] != i, x[1]))
                n, whole = sum(x[0] == i for x in rows), i == j
                if not n or not whole and n == len(rows):
                    continue
                rep, copies = (np.array([x[k] for x in rows], dtype=np.int64) for k in (1, 2))
                vectors, own = np.array([x[3] for x in rows]), np.array([x[4] for x in rows], dtype=np.int64)
                other = slice(0, None) if whole else slice(n, None)
                near = near_pairs(vectors[:n], vectors[other], cosine) & (rep[:n, None] != rep[None, other])
                for earlier in range(t):
                    near &= own[:n, None, earlier] != own[None, other, earlier]
                adjacent = near
                if not whole:
                    adjacent = np.zeros((len(rows), len(rows)), dtype=bool)
                    adjacent[:n, n:], adjacent[n:, :n] = near, near.T
                links = adjacent @ copies
                keep = links > 0
                out += zip(rep[keep].tolist(), links[keep].tolist(), settled(adjacent, rep)[keep].tolist())
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*out) if out else [[]] * 3)], ["rep", "links", "near"])

    return run


def join(vectors: DataFrame, cosine: float = COSINE, recall: float = RECALL, part: int = PART, bits: int | None = None) -> DataFrame:
    """Per vector: vec_id, n_links, component_id (the least id that links reach) and kept (it is that id)."""
    rows = vectors.select(
        F.col("vec_id").cast("long").alias("vec_id"),
        F.col("label").cast("long").alias("label"),
        F.transform(F.col("embedding"), lambda x: x.cast("double") + F.lit(0.0)).alias("vector"),
    )
    finite = F.coalesce(F.forall("vector", lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)) & ~F.isnan(x)) & F.exists("vector", lambda x: x != 0), F.lit(False))
    rows = rows.withColumn("good", finite & F.col("label").isNotNull() & F.col("vec_id").isNotNull())
    hashes = [F.xxhash64("label", "vector").alias("h1"), F.xxhash64("vector", "label").alias("h2")]
    good = rows.where("good").select("vec_id", "label", "vector", *hashes)
    classes = written(
        good.groupBy("label", "vector").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.min("h1").alias("h1"), F.min("h2").alias("h2")).withColumn("size", F.size("vector")), "vectors"
    )
    bits = bits or max(12, min(40, math.ceil(math.log2(classes.count() + 2))))
    tables = tables_for(cosine, recall, bits)
    signed = written(classes.select("label", "size", "rep", "vector").mapInArrow(_hash(tables, bits), "label long, size int, rep long, signs array<long>"), "signs")
    key = ["label", "size", "t", "sign"]
    dealt = signed.select("label", "size", "rep", F.posexplode("signs").alias("t", "sign"))
    buckets = written(dealt.groupBy(*key).agg(F.count("*").alias("k")).where("k > 1").select(*key, F.ceil(F.col("k") / part).cast("int").alias("parts")), "buckets")
    members = dealt.join(buckets, key).withColumn("part", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int"))
    both = F.expr("transform(sequence(0, parts - 1), p -> struct(least(p, part) as i, greatest(p, part) as j))")
    members = members.select(*key, "rep", "part", F.explode(both).alias("b")).select(*key, "rep", "part", "b.i", "b.j")
    full = members.join(classes.select("rep", "label", "size", "copies", "vector"), ["rep", "label", "size"]).join(signed, ["rep", "label", "size"])
    grouped = full.withColumn("grp", F.xxhash64(*key, "i", "j")).repartition("grp").sortWithinPartitions("grp")
    verified = written(grouped.mapInArrow(_verify(cosine), "rep long, links long, near long"), "verified")
    links = verified.groupBy("rep").agg(F.sum("links").alias("links"))
    roots = components(verified.select(F.col("rep").alias("a"), F.col("near").alias("b"))).withColumnRenamed("node", "rep")
    result = classes.join(links, "rep", "left").join(roots, "rep", "left").select("label", "h1", "h2", F.coalesce("root", "rep").alias("component_id"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    one = good.select("vec_id", "label", "h1", "h2").join(result, ["label", "h1", "h2"]).select("vec_id", "n_links", "component_id")
    alone = rows.where("not good").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return one.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def oracle_sql(cosine: float = COSINE) -> str:
    """The same as DuckDB SQL, over all pairs of a label."""
    return f"""
    WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
    g AS (SELECT *, sqrt(list_dot_product(e, e)) AS n FROM v WHERE label IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
    l AS (SELECT x.vec_id AS a, y.vec_id AS b FROM g x JOIN g y ON x.label = y.label AND x.vec_id <> y.vec_id AND len(x.e) = len(y.e) WHERE list_dot_product(x.e, y.e) / (x.n * y.n) >= {cosine}),
    r AS (SELECT vec_id AS node, vec_id AS root FROM v UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.node WHERE r.root < l.b),
    c AS (SELECT node, min(root) AS component_id FROM r GROUP BY 1), k AS (SELECT a, count(*) AS n FROM l GROUP BY 1)
    SELECT v.vec_id, coalesce(k.n, 0)::BIGINT AS n_links, component_id, component_id = v.vec_id AS kept FROM v JOIN c ON c.node = v.vec_id LEFT JOIN k ON k.a = v.vec_id"""
