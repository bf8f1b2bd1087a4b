"""N-gram Jaccard join: MinHash banding, and verification on full n-gram sets.

Documents with equal n-gram sets form one class and go on as its smallest id, with a count.
Bands are shuffled by their hashes; every class links to the smallest id of each bucket, a star
instead of all pairs, and the stars' connected components hold all candidates. Each member then
brings its full set to its component, once and not once per band. Components are verified
in blocks: small ones whole, large ones as pairs of parts in different tasks. A block gives
each member its number of links and one edge of a spanning tree; pairs are never written out.
All pairs of a component are verified, so candidates are a superset of the bands' pairs and the
recall is at least what the band and row counts were chosen for.

A document of fewer words than n has one n-gram, all its words; one without words (null and empty
texts too), or without an id, links with nothing. Very long texts have whole sets like all others. A
pair exactly at the similarity is linked. Rows that share an id are one document: it has the links
of all its texts, and repeated rows count once each as copies. Empty tables give empty results;
other columns are ignored, whatever their names are.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewarden.llm.repeats import groups, mixed, powers, span_hash, sums, units
from tracewarden.llm.shared import components, sliced, written

N, SIMILARITY, RECALL, MOST_HASHES = 5, 0.8, 0.999, 128
#: Members of a part; components up to this size are verified in one task.
PART = 1024


def banding(similarity: float = SIMILARITY, recall: float = RECALL, most: int = MOST_HASHES) -> tuple[int, int]:
    """(bands, rows): the most rows, thus the fewest false candidates, that reach the recall with ``most`` hashes."""
    best = (1, 1)
    for rows in range(1, most + 1):
        bands = max(1, math.ceil(math.log(1 - recall) / math.log(1 - similarity**rows)))
        if bands * rows > most:
            break
        best = (bands, rows)
    return best


def sets_of(texts: pa.Array, n: int) -> list[np.ndarray]:
    """The sorted n-gram hashes of each text."""
    values, offsets, _ = units(texts, by_word=True)
    count = len(values)
    if not count:
        return [values] * len(texts)
    prefix, up = sums(values), powers(count)[0]
    gram = mixed(span_hash(prefix, slice(0, max(0, count - n + 1)), slice(n, max(n, count + 1)), up[: max(0, count - n + 1)]))
    out = []
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        if b - a >= n:
            out.append(np.unique(gram[a : b - n + 1]))
        else:
            out.append(mixed((prefix[b : b + 1] - prefix[a : a + 1]) * up[a : a + 1] + np.uint64(b - a)) if b > a else values[:0])
    return out


def _sketch(n: int, bands: int, rows: int):
    r = np.random.default_rng(20_240_229)
    flips, factors = r.integers(0, 2**64, bands * rows, dtype=np.uint64), r.integers(0, 2**63, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in sliced(batch):
                sets = sets_of(part.column("text"), n)
                size = np.array([len(s) for s in sets], dtype=np.int64)
                full = np.flatnonzero(size)
                flat = np.concatenate(sets) if len(full) else np.zeros(0, np.uint64)
                at = (np.cumsum(size) - size)[full]
                out = np.zeros((len(sets), bands), dtype=np.uint64)
                h1, h2 = np.zeros(len(sets), np.uint64), np.zeros(len(sets), np.uint64)
                if len(full):
                    h1[full], h2[full] = np.add.reduceat(mixed(flat), at), np.bitwise_xor.reduceat(mixed(flat ^ np.uint64(0x5DEECE66D)), at)
                    for band in range(bands):
                        value = np.full(len(full), band, dtype=np.uint64)
                        for i in range(band * rows, band * rows + rows):
                            value = mixed(value ^ np.minimum.reduceat((flat ^ flips[i]) * factors[i], at))
                        out[full, band] = value
                listed = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * bands), pa.array(out.view(np.int64).ravel()))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(size), pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), listed], ["doc_id", "n", "h1", "h2", "bands"])

    return run


def _with_sets(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in sliced(batch):
                sets = pa.array([s.tobytes() for s in sets_of(part.column("text"), n)], pa.binary())
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("root", "rep", "copies", "parts", "part")), sets], ["root", "rep", "copies", "parts", "part", "grams"])

    return run


def intersections(left: list[np.ndarray], right: list[np.ndarray] | None) -> np.ndarray:
    """Sizes of the intersections of sorted sets; of ``left`` with itself if ``right`` is None."""
    sets = left + (right or [])
    if len(sets) == 2:
        common = len(np.intersect1d(*sets, assume_unique=True))
        return np.array([[common]]) if right else np.array([[len(left[0]), common], [common, len(left[1])]])
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, code, count = np.unique(flat, return_inverse=True, return_counts=True)
    everywhere = int((count == len(sets)).sum())
    some = (count > 1) & (count < len(sets))
    column = np.cumsum(some) - 1
    on = some[code]
    code, owner = column[code[on]], owner[on]
    order = np.argsort(code, kind="stable")
    code, owner, width = code[order], owner[order], int(some.sum())
    n = len(left)
    total = np.full((n, len(right) if right else n), everywhere, dtype=np.float32)
    for a in range(0, width, 8192):
        x, y = np.searchsorted(code, (a, a + 8192))
        block = np.zeros((len(sets), min(8192, width - a)), dtype=np.float32)
        block[owner[x:y], code[x:y] - a] = 1
        total += block[:n] @ (block[n:] if right else block).T
    return total


def linked(left: list[np.ndarray], right: list[np.ndarray] | None, similarity: float) -> np.ndarray:
    common = intersections(left, right)
    a, b = np.array([len(s) for s in left]), np.array([len(s) for s in (right or left)])
    return common >= similarity * (a[:, None] + b[None, :] - common) - 1e-6


def settled(adjacent: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """The least id that each node reaches."""
    label, big = ids.copy(), np.iinfo(np.int64).max
    while True:
        new = np.minimum(label, np.where(adjacent, label[None, :], big).min(axis=1))
        if (new == label).all():
            return label
        label = new


def _verify(similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups(batches, "grp"):
            blocks: dict[tuple[int, int, int], dict] = {}
            for root, i, j, part, rep, copies, grams in zip(*(table.column(c).to_pylist() for c in ("root", "i", "j", "part", "rep", "copies", "grams"))):
                blocks.setdefault((root, i, j), {})[part, rep, grams] = copies
            out: list[tuple[int, int, int]] = []
            for (_, i, j), held in blocks.items():
                rows = sorted(held.items(), key=lambda x: (x[0][0] != i, x[0][1]))
                n = sum(part == i for (part, _, _), _ in rows)
                sets = [np.frombuffer(grams, dtype=np.uint64) for (_, _, grams), _ in rows]
                rep = np.array([rep for (_, rep, _), _ in rows], dtype=np.int64)
                copies = np.array(list(c for _, c in rows), dtype=np.int64)
                whole = i == j
                if not n or not whole and n == len(rows):
                    continue
                near = linked(sets[:n], None if whole else sets[n:], similarity)
                near &= rep[:n, None] != (rep[None, :] if whole else rep[None, n:])
                adjacent = near
                if not whole:
                    adjacent = np.zeros((len(rows), len(rows)), dtype=bool)
                    adjacent[:n, n:], adjacent[n:, :n] = near, near.T
                links = adjacent @ copies
                keep = links > 0
                out += zip(rep[keep].tolist(), links[keep].tolist(), settled(adjacent, rep)[keep].tolist())
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*out) if out else [[]] * 3)], ["rep", "links", "near"])

    return run


def join(docs: DataFrame, similarity: float = SIMILARITY, n: int = N, recall: float = RECALL, part: int = PART) -> DataFrame:
    """Per document: doc_id, class_id (the least id that links reach), n_links (documents linked directly) and kept (it is the class's id)."""
    bands, rows = banding(similarity, recall)
    body = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    sketch = written(body.mapInArrow(_sketch(n, bands, rows), "doc_id long, n long, h1 long, h2 long, bands array<long>"), "sketch")
    real = sketch.where("n > 0 and doc_id is not null")
    key = ["n", "h1", "h2"]
    classes = written(real.groupBy(*key).agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.any_value("bands").alias("bands")), "classes")
    # stars instead of pairs
    banded = classes.select("rep", F.posexplode("bands").alias("band", "value"))
    buckets = written(banded.groupBy("band", "value").agg(F.min("rep").alias("low"), F.count("*").alias("k")).where("k > 1").drop("k"), "buckets")
    found = components(banded.join(buckets, ["band", "value"]).select(F.col("rep").alias("a"), F.col("low").alias("b")))
    # members with their parts
    found = written(found.select(F.col("node").alias("rep"), "root"), "candidates")
    parts = found.groupBy("root").agg(F.ceil(F.count("*") / part).cast("int").alias("parts"))
    members = found.join(parts, "root").join(classes.groupBy("rep").agg(F.max("copies").alias("copies")), "rep").withColumn("part", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int"))
    sets = body.join(members.withColumnRenamed("rep", "doc_id"), "doc_id").withColumnRenamed("doc_id", "rep").mapInArrow(_with_sets(n), "root long, rep long, copies long, parts int, part int, grams binary")
    both = F.expr("transform(sequence(0, parts - 1), p -> struct(least(p, part) as i, greatest(p, part) as j))")
    blocks = sets.select("root", "rep", "copies", "part", "grams", F.explode(both).alias("b")).select("root", "rep", "copies", "part", "grams", "b.i", "b.j")
    dealt = blocks.withColumn("grp", F.xxhash64("root", "i", "j")).repartition("grp").sortWithinPartitions("grp")
    verified = written(dealt.mapInArrow(_verify(similarity), "rep long, links long, near long"), "verified")
    links = verified.groupBy("rep").agg(F.sum("links").alias("links"))
    roots = components(verified.select(F.col("rep").alias("a"), F.col("near").alias("b"))).withColumnRenamed("node", "rep")
    result = classes.drop("bands").join(links, "rep", "left").join(roots, "rep", "left").select(*key, F.coalesce("root", "rep").alias("class_id"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    one = real.select("doc_id", *key).join(result, key).select("doc_id", "class_id", "n_links")
    alone = sketch.where("n = 0 or doc_id is null").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"))
    return one.unionByName(alone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("class_id"), F.lit(True)))


def oracle_sql() -> str:
    """``join`` as DuckDB SQL for five words and 0.8: all pairs that share an n-gram, counted in full."""
    return r"""
    WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
    g AS (SELECT DISTINCT doc_id, CASE WHEN len(ws) < 5 THEN array_to_string(ws, ' ') ELSE array_to_string(ws[i:i + 4], ' ') END AS s FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, least(len(ws), 1) + 1))) AS i FROM w)),
    n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY 1), m AS (SELECT s FROM g GROUP BY 1 HAVING count(*) > 1), h AS (SELECT g.* FROM g JOIN m USING (s)),
    p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM h x JOIN h y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY 1, 2),
    l AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 5 * c >= 4 * (na.n + nb.n - c)), e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
    r AS (SELECT doc_id AS node, doc_id AS root FROM w UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.node WHERE r.root < e.b),
    t AS (SELECT node, min(root) AS class_id FROM r GROUP BY 1), k AS (SELECT a, count(*) AS k FROM e GROUP BY 1)
    SELECT node AS doc_id, class_id, coalesce(k, 0)::BIGINT AS n_links, class_id = node AS kept FROM t LEFT JOIN k ON k.a = node"""
