"""Packing: every piece placed once, without gaps, in few sequences."""

import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tracewarden.llm import bpe, packing


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=9))
def test_bound_is_below_the_optimum(lengths):
    size = 20

    def optimum(rest, bins):
        if not rest:
            return len(bins)
        best = 99
        for i in range(len(bins)):
            if bins[i] >= rest[0]:
                bins[i] -= rest[0]
                best = min(best, optimum(rest[1:], bins))
                bins[i] += rest[0]
        return min(best, optimum(rest[1:], [*bins, size - rest[0]]))

    x = np.array(lengths, dtype=np.int64)
    bins = packing.best_fit(x, size)
    assert all(x[bins == b].sum() <= size for b in set(bins.tolist()))
    if len(lengths) <= 7:
        assert packing.lower_bound(x, size) <= optimum(sorted(lengths, reverse=True), []) <= len(set(bins.tolist()))


def check(rows, size):
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= size
    return len(by)


@pytest.mark.parametrize("deal", [packing.DEAL, 40])
def test_documents(spark, monkeypatch, deal):
    monkeypatch.setattr(packing, "DEAL", deal)
    r = random.Random(3)
    texts = [None, "", "x"] + ["tin river " * r.randint(0, 300) for _ in range(400)] + ["stone " * n for n in (1022, 1023, 1024, 2047, 5000)]
    docs = spark.createDataFrame([(i, t, "a") for i, t in enumerate(texts)] + [(1, "", "a"), (None, "y", "b")], "doc_id long, text string, length string")
    rows = packing.packed(docs).collect()
    library = Tokenizer.from_file(bpe.default_path())
    n = check(rows, 1024)
    lengths = np.array([x.length for x in rows])
    assert n <= packing.lower_bound(lengths, 1024) + 1
    for i, t in enumerate(texts):
        own = sorted((x for x in rows if x.doc_id == i), key=lambda x: x.start)
        if i == 1:
            assert [x.length for x in own] == [1, 1]
            continue
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 2]
        assert [x.piece for x in own] == list(range(len(own))) and sum(x.length for x in own) == len(ids)
        for x in own:
            assert x.length == 1024 or x.piece == 0
            assert x.ids_crc32 == zlib.crc32(np.array(ids[x.start : x.start + x.length], dtype="<u4").tobytes())
    assert packing.packed(docs.limit(0)).count() == 0


def test_exchange_closes_gaps(spark, monkeypatch):
    monkeypatch.setattr(packing, "DEAL", 10)
    items = spark.createDataFrame([(i, 0, 0, 100 + 7 * i % 500, 0) for i in range(300)], packing.PIECES)
    rows = packing.pack(items).collect()
    lengths = np.array([100 + 7 * i % 500 for i in range(300)])
    alone = sum(int(packing.best_fit(lengths[i::30], 1024).max()) + 1 for i in range(30))
    n = check(rows, 1024)
    assert len(rows) == 300 and packing.lower_bound(lengths, 1024) <= n < alone - 10


@pytest.mark.parametrize("seed", [1, 2])
def test_rounds_of_several_partitions_lay_out_once_and_never_worsen(spark, monkeypatch, seed):
    monkeypatch.setattr(packing, "DEAL", 10)
    monkeypatch.setattr(packing, "MEET", 2)
    rounds, write = [], packing.written

    def noted(df, name):
        out = write(df, name)
        if name.startswith("packed"):
            rounds.append([tuple(x) for x in out.select("doc_id", "sequence_id", "done").collect()])
        return out

    monkeypatch.setattr(packing, "written", noted)
    r = random.Random(seed)
    lengths = [r.choice([r.randint(490, 540), r.randint(780, 1000), r.randint(20, 240)]) for _ in range(160)]
    items = spark.createDataFrame([(i, 0, 0, n, 0) for i, n in enumerate(lengths)], packing.PIECES)
    rows = packing.pack(items).collect()
    assert sorted(x.doc_id for x in rows) == list(range(160)) and len(rounds) > 3
    n = check(rows, 1024)
    totals, closed = [], set()
    for now in rounds:
        totals.append(len(closed | {q for _, q, _ in now}))
        closed |= {q for _, q, done in now if done}
    assert totals == sorted(totals, reverse=True) and totals[-1] == n
