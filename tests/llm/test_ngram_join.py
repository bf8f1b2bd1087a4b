"""The Jaccard join against all pairs."""

import random
import re

import pytest

from tracewarden.llm import ngram_join


def grams(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}


def brute(rows):
    sets = {i: grams(t) for i, t in rows}
    ids = [i for i in sets if sets[i]]
    links = {i: {j for j in ids if j != i and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])} if sets[i] else set() for i in sets}
    root = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for i in sets:
            low = min([root[i], *(root[j] for j in links[i])])
            changed |= low != root[i]
            root[i] = low
    return {i: (root[i], len(links[i]), root[i] == i) for i in sets}


@pytest.mark.parametrize("part", [ngram_join.PART, 7])
def test_against_all_pairs(spark, part):
    r = random.Random(4)
    words = [f"w{i}" for i in range(500)]
    text = lambda n: " ".join(r.choices(words, k=n))
    base, chain = text(100), text(150).split()
    rows = [(i, text(r.randint(0, 80))) for i in range(60)] + [(100 + i, base) for i in range(5)] + [(200, None), (201, ""), (202, "a b"), (203, "a  b"), (204, "x"), (205, text(4000))]
    for i in range(40):
        w = base.split()
        for _ in range(i % 4):
            w[r.randrange(100)] = f"e{i}"
        rows.append((300 + i, " ".join(w)))
    for i in range(12):
        chain[i * 6] = f"c{i}"
        rows.append((400 + i, " ".join(chain)))
    docs = spark.createDataFrame([(i, t, "z") for i, t in rows], "doc_id long, text string, class_id string").repartition(3)
    got = {x.doc_id: (x.class_id, x.n_links, x.kept) for x in ngram_join.join(docs, part=part).collect()}
    assert got == brute(rows)


def test_edges(spark):
    docs = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (2, None)], "doc_id long, text string")
    rows = ngram_join.join(docs).collect()
    assert sorted((r.doc_id or 0, r.class_id or 0) for r in rows) == [(0, 0), (1, 1), (1, 1), (2, 2)]
    assert ngram_join.join(docs.limit(0)).count() == 0


def test_banding():
    bands, rows = ngram_join.banding()
    assert 1 - (1 - 0.8**rows) ** bands >= 0.999 and bands * rows <= 128


def test_recall_by_similarity(spark, data_dir):
    """Every pair at or above the threshold is linked, measured against all pairs: of real documents, and of planted pairs near the threshold."""
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{data_dir}/documents.parquet").select("doc_id", "text").collect()]
    r = random.Random(8)
    words = [f"v{i}" for i in range(3000)]
    for i in range(150):
        w = r.choices(words, k=160)
        rows.append((50_000 + 2 * i, " ".join(w)))
        for _ in range(i % 6):
            w[r.randrange(160)] = "other"
        rows.append((50_001 + 2 * i, " ".join(w)))
    sets = {i: grams(t) for i, t in rows}
    got = {x.doc_id: x.n_links for x in ngram_join.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    found, wanted = {}, {}
    for i in range(150):
        a, b = sets[50_000 + 2 * i], sets[50_001 + 2 * i]
        s = len(a & b) / len(a | b)
        bin_ = min(9, int(s * 10))
        wanted[bin_] = wanted.get(bin_, 0) + (s >= 0.8)
        found[bin_] = found.get(bin_, 0) + (got[50_000 + 2 * i] > 0)
    assert found == wanted and wanted[8] > 20 and wanted.get(7, 0) == 0
    assert got == {i: n for i, (_, n, _) in brute(rows).items()}
