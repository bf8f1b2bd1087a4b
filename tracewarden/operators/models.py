"""Models that Spark has no operator for: isolation forest, reconstruction errors, vector retrieval, online memory."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tracewarden.session import settled


def _path(n: int) -> float:
    """The mean length of a path in a tree of so many rows."""
    return 0.0 if n <= 1 else 1.0 if n == 2 else 2 * (np.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n


def _tree(x: np.ndarray, r: np.random.Generator, limit: int) -> list[tuple[int, float, int, float]]:
    """Nodes (column, cut, place of the lower child, length): column -1 is a leaf, the upper child comes after the lower one."""
    nodes: list[tuple[int, float, int, float]] = [(-1, 0.0, 0, 0.0)]
    todo = [(0, x, 0)]
    while todo:
        at, own, depth = todo.pop()
        low, high = (own.min(axis=0), own.max(axis=0)) if len(own) else (np.zeros(0), np.zeros(0))
        spread = np.flatnonzero(high > low)
        if depth >= limit or len(own) <= 1 or not len(spread):
            nodes[at] = (-1, 0.0, at, depth + _path(len(own)))
            continue
        column = int(r.choice(spread))
        cut = r.uniform(low[column], high[column])
        less = own[:, column] < cut
        nodes[at] = (column, cut, len(nodes), 0.0)
        todo += [(len(nodes), own[less], depth + 1), (len(nodes) + 1, own[~less], depth + 1)]
        nodes += [(-1, 0.0, 0, 0.0)] * 2
    return nodes


def isolation_forest(df: DataFrame, columns: list[str], key: str, trees: int = 100, sample: int = 256, seed: int = 7) -> DataFrame:
    """``df`` with iforest_score: higher is more unusual. Each tree sees ``sample`` rows, taken by a hash of the key, so the trees have a fixed size.

    The trees are arrays; a batch goes down all of them at once, one level after another.
    """
    rows = df.select(key, *columns).orderBy(F.xxhash64(F.col(key), F.lit(seed))).limit(trees * sample).toPandas()[columns].fillna(0.0).to_numpy(float)
    r = np.random.default_rng(seed)
    size = min(sample, len(rows))
    limit = int(np.ceil(np.log2(max(2, size))))
    grown = [_tree(rows[r.choice(len(rows), size, replace=False)], r, limit) for _ in range(trees)] if len(rows) else []
    widest = max(map(len, grown), default=0)
    packed = np.zeros((len(grown), widest), dtype=[("column", "i2"), ("cut", "f8"), ("child", "i4"), ("length", "f8")])
    for own, nodes in zip(packed, grown):
        own[: len(nodes)] = nodes
    held = df.sparkSession.sparkContext.broadcast((packed, limit, _path(size) or 1.0))

    @F.pandas_udf("double")
    def score(*values: pd.Series) -> pd.Series:
        forest, levels, norm = held.value
        x = pd.concat(values, axis=1).fillna(0.0).to_numpy(float)
        if not len(forest) or not len(x):
            return pd.Series(np.zeros(len(x)))
        total, every = np.zeros(len(x)), np.arange(len(x))
        for tree in forest:
            column, cut, child = tree["column"], tree["cut"], tree["child"]
            at = np.zeros(len(x), dtype=np.int32)
            for _ in range(levels):
                own = column[at]
                at = np.where(own < 0, at, child[at] + (x[every, own] >= cut[at]))
            total += tree["length"][at]
        return pd.Series(2.0 ** (-total / len(forest) / norm))

    return df.withColumn("iforest_score", score(*(F.col(c).cast("double") for c in columns)))


def principal_axes(df: DataFrame, columns: list[str], k: int, weight: Column | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(means, the first ``k`` axes) from one aggregation of weighted sums and products: its size depends on the columns only."""
    w = F.lit(1.0) if weight is None else weight
    sums = [F.sum(w).alias("w"), *(F.sum(w * F.col(c)).alias(f"s{i}") for i, c in enumerate(columns))]
    sums += [F.sum(w * F.col(a) * F.col(b)).alias(f"p{i}_{j}") for i, a in enumerate(columns) for j, b in enumerate(columns) if i <= j]
    row = df.agg(*sums).first()
    total, n = row["w"] or 1.0, len(columns)
    mean = np.array([row[f"s{i}"] or 0.0 for i in range(n)]) / total
    cov = np.array([[row[f"p{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(n)] for i in range(n)]) / total - np.outer(mean, mean)
    _, axes = np.linalg.eigh(cov)
    return mean, axes[:, ::-1][:, :k]


def reconstruction_error(df: DataFrame, columns: list[str], k: int, weight: Column | None = None, out: str = "recon_error") -> DataFrame:
    """The mean squared distance of each row from the space of the first ``k`` axes, as plain column arithmetic."""
    mean, axes = principal_axes(df, columns, k, weight)
    rest = np.eye(len(columns)) - axes @ axes.T
    centred = [F.col(c) - float(m) for c, m in zip(columns, mean)]
    total = None
    for row in rest:
        part = sum((c * float(v) for c, v in zip(centred, row)), F.lit(0.0))
        total = part * part if total is None else total + part * part
    return df.withColumn(out, total / len(columns))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def _best(query: np.ndarray, ids: np.ndarray, sim: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of (query, id, sim) triples the ``k`` best of each query, ties by id."""
    order = np.lexsort((ids, -np.round(sim, 12), query))
    query, ids, sim = query[order], ids[order], sim[order]
    firsts = np.flatnonzero(np.diff(query, prepend=-1))
    keep = np.arange(len(query)) - np.repeat(firsts, np.diff([*firsts, len(query)])) < k
    return query[keep], ids[keep], sim[keep]


def _unit(vectors) -> np.ndarray:
    v = np.array(list(vectors), dtype=float)
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)


def vector_top_k(queries: DataFrame, corpus: DataFrame, k: int, least: float = -1.0, block: int = 16_384, number: str | None = None, share: float = 0.7) -> DataFrame:
    """(query_id, vec_id, sim, rank): the ``k`` nearest rows of ``corpus`` (vec_id, vector) by cosine for each stated query (query_id, vector).

    Queries go out in blocks of fixed size, of which the driver holds one; each corpus partition gives
    its own ``k`` best for each query, so what is shuffled is queries x k x partitions. With ``number``,
    a column of both sides, sim is ``share`` of the cosine and the rest of exp(-|difference of numbers|).
    """
    extra = [number] if number else []

    def found_in(own: list) -> DataFrame:
        held = queries.sparkSession.sparkContext.broadcast((np.array([q[0] for q in own], dtype=np.int64), _unit(q[1] for q in own), np.array([q[2] for q in own], dtype=float) if number else None))

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            ids, q, numbers = held.value
            best = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
            for rows in batches:
                if not len(rows):
                    continue
                v, own_id = _unit(rows["vector"]), rows["vec_id"].to_numpy()
                fresh = [best]
                for a in range(0, len(ids), 256):
                    sim = q[a : a + 256] @ v.T
                    if number:
                        sim = share * sim + (1 - share) * np.exp(-np.abs(numbers[a : a + 256, None] - rows[number].to_numpy(float)[None, :]))
                    near = np.round(sim, 12)
                    edge = np.partition(near, -k, axis=1)[:, -k] if near.shape[1] > k else np.full(len(near), -np.inf)
                    i, j = np.nonzero(near >= edge[:, None])
                    fresh.append(_best(i + a, own_id[j], sim[i, j], k))
                best = _best(*(np.concatenate(x) for x in zip(*fresh)), k)
            if len(best[0]):
                yield pd.DataFrame({"query_id": ids[best[0]], "vec_id": best[1], "sim": best[2]})

        return corpus.select("vec_id", "vector", *extra).mapInPandas(run, "query_id long, vec_id long, sim double")

    out, own = None, []
    for row in queries.select("query_id", "vector", *extra).orderBy("query_id").toLocalIterator():
        own.append(row)
        if len(own) == block:
            out, own = found_in(own) if out is None else out.unionAll(found_in(own)), []
    if own:
        out = found_in(own) if out is None else out.unionAll(found_in(own))
    if out is None:
        out = queries.sparkSession.createDataFrame([], "query_id long, vec_id long, sim double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.round("sim", 12)), "vec_id"))
    return out.where(F.col("sim") >= least).withColumn("rank", rank).where(F.col("rank") <= k)


def online_memory(df: DataFrame, by: list[str], order: str, vector: str, tau: float) -> DataFrame:
    """Grows templates in order within each group: a row that is as near as ``tau`` to a template adds to its hits, others become new ones."""

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        templates: list[np.ndarray] = []
        which, hits = [], []
        counts: list[int] = []
        for v in rows.sort_values(order)[vector]:
            x = np.asarray(v, dtype=float)
            x = x / max(float(np.linalg.norm(x)), 1e-300)
            sims = np.array(templates) @ x if templates else np.zeros(0)
            j = int(sims.argmax()) if len(sims) and sims.max() >= tau else len(templates)
            if j == len(templates):
                templates.append(x)
                counts.append(0)
            counts[j] += 1
            which.append(j)
            hits.append(counts[j])
        out = rows.sort_values(order)[[*by, order]].copy()
        out["template"], out["hits"] = which, hits
        return out

    schema = StructType([*df.select(*by, order).schema.fields, StructField("template", LongType()), StructField("hits", LongType())])
    return df.select(*by, order, vector).groupBy(*by).applyInPandas(fold, schema)


def _new_templates(x: np.ndarray, tau: float, step: int = 512) -> np.ndarray:
    """The places of the rows of ``x``, in order, that are not as near as ``tau`` to an earlier such row."""
    kept, n, out = np.empty_like(x), 0, []
    for a in range(0, len(x), step):
        rows = x[a : a + step]
        open_ = np.ones(len(rows), dtype=bool)
        for b in range(0, n, 4096):
            open_ &= np.round(rows @ kept[b : min(b + 4096, n)].T, 12).max(axis=1) < tau
        near = np.round(rows @ rows.T, 12) >= tau
        for i in np.flatnonzero(open_).tolist():
            if open_[i]:
                kept[n], n = rows[i], n + 1
                out.append(a + i)
                open_[i + 1 :] &= ~near[i, i + 1 :]
    return np.array(out, dtype=np.int64)


def one_memory(df: DataFrame, order: str, vector: str, tau: float, block: int = 16_384) -> DataFrame:
    """``online_memory`` as one memory over all rows: (other columns, order, template, hits).

    ``order`` holds distinct whole numbers. Rows come in blocks of the order, each as long as all before it but at most
    ``block`` rows on average. The rows of a block are compared with all earlier templates where they stand; only those
    without a match go to the driver, which finds the new templates among them and carries the exact matrix on. Then every
    row takes the nearest template that is not younger than itself, and hits are counted along the order by ranges and totals.
    """
    context, other = df.sparkSession.sparkContext, [c for c in df.columns if c not in (order, vector)]
    rows = df.withColumn(order, F.col(order).cast("long")).select(*other, order, vector)
    n = rows.count()
    edges, at = [], 1024
    while at < n:
        edges.append(at / n)
        at += min(at, block)
    cuts = sorted(set(rows.stat.approxQuantile(order, edges, 0.0001))) if edges else []
    held_ids, held = np.zeros(0, dtype=np.int64), np.zeros((0, 0))

    def without_match(ids: np.ndarray, templates: np.ndarray):
        given = context.broadcast((ids, templates))

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            _, t = given.value
            for part in batches:
                if not len(part):
                    continue
                x, open_ = _unit(part[vector]), np.ones(len(part), dtype=bool)
                for b in range(0, len(t), 1024):
                    open_ &= np.round(x @ t[b : b + 1024].T, 12).max(axis=1) < tau
                yield part[open_]

        return run

    for low, high in zip([None, *cuts], [*cuts, None]):
        own = rows.select(order, vector)
        own = own if low is None else own.where(F.col(order) > int(low))
        own = own if high is None else own.where(F.col(order) <= int(high))
        if len(held):
            own = own.mapInPandas(without_match(held_ids, held), own.schema)
        found = own.toPandas().sort_values(order)
        if len(found):
            x = _unit(found[vector])
            new = _new_templates(x, tau)
            held_ids, held = np.concatenate([held_ids, found[order].to_numpy()[new]]), np.concatenate([held.reshape(-1, x.shape[1]), x[new]])
    given = context.broadcast((held_ids, held))

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, t = given.value
        for part in batches:
            if not len(part):
                continue
            x, here = _unit(part[vector]), np.searchsorted(ids, part[order].to_numpy(), side="right")
            best, which = np.full(len(x), -np.inf), np.zeros(len(x), dtype=np.int64)
            for b in range(0, len(t), 1024):
                sim = np.round(x @ t[b : b + 1024].T, 12)
                sim[np.arange(b, b + sim.shape[1])[None, :] >= here[:, None]] = -np.inf
                j = sim.argmax(axis=1)
                better = sim[np.arange(len(x)), j] > best
                best[better], which[better] = sim[np.arange(len(x)), j][better], j[better] + b
            alone = best < tau  # only a vector of zeros is not as near to itself
            which[alone] = here[alone] - 1
            yield part[[*other, order]].assign(template=which)

    schema = StructType([*rows.select(*other, order).schema.fields, StructField("template", LongType())])
    assigned = settled(rows.mapInPandas(assign, schema), "memory")
    # running counts by range of the order: rows of one template and range are numbered, totals of earlier ranges added
    spread = F.lit(0)
    for cut in cuts:
        spread = spread + (F.col(order) > int(cut)).cast("int")
    placed = assigned.withColumn("range", spread)
    totals = placed.groupBy("template", "range").agg(F.count("*").alias("n"))
    before = totals.withColumn("before", F.sum("n").over(Window.partitionBy("template").orderBy("range")) - F.col("n")).drop("n")
    number = F.row_number().over(Window.partitionBy("template", "range").orderBy(order))
    return placed.withColumn("number", number).join(before, ["template", "range"]).select(*other, order, "template", (F.col("number") + F.col("before")).alias("hits"))


def memory_stats(assigned: DataFrame) -> DataFrame:
    """One row on a memory from the templates (template) that rows met: templates, hits, most (of one), singles."""
    each = assigned.groupBy("template").agg(F.count("*").alias("n"))
    return each.agg(F.count("*").alias("templates"), F.coalesce(F.sum("n"), F.lit(0)).alias("hits"), F.max("n").alias("most"), F.count_if(F.col("n") == 1).alias("singles"))
