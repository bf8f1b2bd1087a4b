"""Embedding near-dedup against all pairs."""

import numpy as np
import pytest

from tracewarden.llm import embedding_dedup


def brute(rows):
    good = {i: np.array(v, float) for i, label, v in rows if v is not None and label is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    label = {i: k for i, k, _ in rows}
    cos = lambda a, b: a @ b / np.sqrt((a @ a) * (b @ b))
    links = {i: {j for j in good if i in good and i != j and label[i] == label[j] and len(good[i]) == len(good[j]) and cos(good[i], good[j]) >= 0.98} for i, _, _ in rows}
    root = {i: i for i in links}
    for _ in root:
        root = {i: min([root[i], *(root[j] for j in links[i])]) for i in root}
    return {i: (len(links[i]), root[i], root[i] == i) for i in root}


@pytest.mark.parametrize("part,bits", [(embedding_dedup.PART, None), (5, 12)])
def test_against_all_pairs(spark, part, bits):
    r = np.random.default_rng(1)
    rows, centre = [], r.standard_normal((6, 16))
    for i in range(240):
        v = centre[i % 6] + r.standard_normal(16) * (0.02, 0.1, 0.14, 0.5)[i // 60]
        rows.append((i, i % 3, np.float32(v).tolist()))
    rows += [(300 + i, 1, rows[7][2]) for i in range(12)] + [(320 + i, 2, rows[7][2]) for i in range(3)]
    rows += [(400, 1, None), (401, 1, [0.0] * 16), (402, 1, [float("nan")] + [1.0] * 15), (403, None, rows[7][2]), (404, 1, [1.0, None]), (405, 1, []), (406, 1, [float("inf"), 1.0]), (407, 1, [1.0, 2.0]), (408, 1, [2.0, 4.0]), (409, 0, [-0.0, 1.0]), (410, 0, [0.0, 1.0])]
    table = spark.createDataFrame([(*x, "n") for x in rows], "vec_id long, label int, embedding array<float>, size string").repartition(3)
    got = {x.vec_id: (x.n_links, x.component_id, x.kept) for x in embedding_dedup.join(table, part=part, bits=bits, recall=0.999999).collect()}
    assert got == brute(rows)


def test_edges(spark):
    table = spark.createDataFrame([(1, 1, [1.0, 2.0]), (1, 1, [1.0, 2.0]), (None, 1, [1.0, 2.0])], "vec_id long, label int, embedding array<float>")
    assert sorted((r.vec_id or 0, r.component_id or 0) for r in embedding_dedup.join(table).collect()) == [(0, 0), (1, 1), (1, 1)]
    assert embedding_dedup.join(table.limit(0)).count() == 0


def test_recall():
    r = np.random.default_rng(2)
    a = r.standard_normal((4000, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = r.standard_normal((4000, 64))
    b -= (a * b).sum(axis=1, keepdims=True) * a
    b = 0.98 * a + np.sqrt(1 - 0.98**2) * b / np.linalg.norm(b, axis=1, keepdims=True)
    tables = embedding_dedup.tables_for(0.98, 0.999, 16)
    met = (embedding_dedup.signs(a, tables, 16) == embedding_dedup.signs(b, tables, 16)).any(axis=1)
    assert met.mean() > 0.99
