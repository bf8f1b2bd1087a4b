"""Substring operators against brute force over all windows."""

import hashlib
import random
import re
from collections import defaultdict

import pytest

from tracewarden.llm import repeats, substring_dedup, suffix_array_dedup

WORDS = "the of and rain stone river cloud metal paper glass tin".split()


def corpus(seed: int) -> list[tuple[int | None, str | None]]:
    r = random.Random(seed)
    text = lambda n: " ".join(r.choice(WORDS) for _ in range(n))
    base, passage = text(40), text(25)
    rows = [(i, text(r.randint(0, 60))) for i in range(20)]
    rows += [(20 + i, base) for i in range(6)]
    for i in range(25):
        w = base.split()
        w[r.randrange(len(w))] = "édit%d" % i
        rows.append((30 + i, " ".join(w)))
    rows += [(60 + i, f"{text(5)}\n{passage}\t{text(r.randint(0, 8))}") for i in range(25)]
    rows += [(100, None), (101, ""), (102, "a " * 70), (103, "ab" * 90), (104, "x"), (105, " \n\t"), (106, "a " * 50), (107, base + " " + base)]
    r.shuffle(rows)
    return rows


def covered(texts: list[bytes], least: int) -> list[bytes]:
    """For each text a mask of the bytes in strings of ``least`` bytes that also start elsewhere."""
    seen = defaultdict(int)
    for b in texts:
        for s in range(len(b) - least + 1):
            seen[b[s : s + least]] += 1
    out = []
    for b in texts:
        gone = bytearray(len(b))
        for s in range(len(b) - least + 1):
            if seen[b[s : s + least]] > 1:
                gone[s : s + least] = b"\1" * least
        out.append(bytes(gone))
    return out


def brute_bytes(rows, least, passage, words):
    texts = [(t or "").encode() for _, t in rows]
    out = {}
    for (i, _), b, gone, more in zip(rows, texts, covered(texts, least), covered(texts, passage)):
        told = [m.span() for m in re.finditer(b"\1+", more) if len(re.findall(rb"[^\x20\x09-\x0D]+", b[m.start() : m.end()])) > words]
        left = hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()
        out[i] = (len(b), sum(gone), len(re.findall(b"\1+", gone)), left, len(told), sum(y - x for x, y in told))
    return out


def brute_words(rows, least):
    first, out = set(), {}
    for i, t in sorted(rows):
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        gone = [False] * len(w)
        for s in range(len(w) - least + 1):
            key = tuple(w[s : s + least])
            if key in first:
                gone[s : s + least] = [True] * least
            first.add(key)
        out[i] = (len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone) if not g).encode()).hexdigest())
    return out


@pytest.mark.parametrize("bands", [repeats.BANDS, ((3, 5), (12, 1))])
@pytest.mark.parametrize("least,passage,gram", [(40, 25, 10), (60, 60, 30)])
def test_bytes(spark, least, passage, gram, bands):
    rows = corpus(least)
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, k1 int").repartition(5)
    got = {r[0]: tuple(r[1:]) for r in suffix_array_dedup.digests(docs, least, passage=passage, words=6, gram=gram, bands=bands).collect()}
    assert got == brute_bytes(rows, least, passage, 6)


def test_production_lengths(spark, data_dir):
    """The registered parameters on real rows, near copies of them, and one very long text."""
    r = random.Random(7)
    rows = [(x.doc_id, x.text) for x in spark.read.parquet(f"{data_dir}/documents.parquet").orderBy("doc_id").limit(60).collect()]
    for i in range(30):
        text = rows[i][1] or ""
        a = r.randrange(len(text) + 1)
        rows.append((10_000 + i, text[:a] + f" edit{i} " + text[a:]))
    rows.append((20_000, " ".join(t or "" for _, t in rows[:25]) + " " + " ".join(r.choices(WORDS, k=30_000))))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    for bands in (repeats.BANDS, ((3, 16), (9, 1))):
        got = {x[0]: tuple(x[1:]) for x in suffix_array_dedup.digests(docs, bands=bands).collect()}
        assert got == brute_bytes(rows, 400, 240, 50)
    for bands in (substring_dedup.BANDS, ((3, 3), (9, 1))):
        got = {x[0]: tuple(x[1:]) for x in substring_dedup.digests(docs, bands=bands).collect()}
        assert got == brute_words(rows, 20)


def test_passages_are_cleaned(spark):
    passage = " ".join(f"w{i}" for i in range(100, 170))
    docs = spark.createDataFrame([(1, "first " + passage, "x"), (2, passage + " second", "y"), (3, "other", "z")], "doc_id long, text string, lo0 string")
    assert len(passage) < 400
    got = {r.doc_id: (r.text, r.lo0) for r in suffix_array_dedup.cleaned(docs, words=50).collect()}
    assert got == {1: ("first ", "x"), 2: (" second", "y"), 3: ("other", "z")}
    assert {r.text for r in suffix_array_dedup.cleaned(docs).collect()} == {r.text for r in docs.collect()}


@pytest.mark.parametrize("bands", [repeats.BANDS, ((3, 2), (12, 1))])
@pytest.mark.parametrize("least,gram", [(6, 2), (10, 3)])
def test_words(spark, least, gram, bands):
    rows = corpus(least)
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, grp int").repartition(5)
    got = {r[0]: tuple(r[1:]) for r in substring_dedup.digests(docs, least, gram=gram, bands=bands).collect()}
    assert got == brute_words(rows, least)


def test_empty_and_repeated_rows(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert suffix_array_dedup.digests(none).count() == 0 and substring_dedup.digests(none).count() == 0
    long = "word " * 8 + " ".join(map(str, range(200)))
    docs = spark.createDataFrame([(1, long), (1, long), (None, "x"), (2, None)], "doc_id long, text string")
    got = sorted(suffix_array_dedup.digests(docs).collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0))
    assert [(r.doc_id, r.n_removed) for r in got] == [(1, len(long)), (1, len(long)), (2, 0), (None, 0)]
    assert suffix_array_dedup.cleaned(docs).where("doc_id = 1").first().text == ""
    assert {r.n_removed for r in substring_dedup.digests(docs).collect()} == {0}


def test_maximal_repeats_have_all_occurrences():
    members = [(b"xabcdefq", 3), (b"yabcdefz", 3), (b"xabcdefw", 3), (b"kkcdefgh"[1:], 1)]
    found = {(n, tuple(sorted(w))) for n, w in suffix_array_dedup.maximal_repeats(members, 4)}
    assert (7, ((0, 0), (2, 0))) in found and (6, ((0, 1), (1, 1), (2, 1))) in found and (4, ((0, 3), (1, 3), (2, 3), (3, 1))) in found


def test_repeat_groups(spark):
    passage = " ".join(str(i * 7919) for i in range(60))
    docs = spark.createDataFrame([(1, "abc " + passage), (2, passage + " tail"), (3, "other")], "doc_id long, text string")
    rows = suffix_array_dedup.repeat_groups(docs, 200, 50).collect()
    assert rows and all(len(r.occurrences) == 2 for r in rows)


@pytest.mark.parametrize("size", [30, 200, 100_000])
def test_against_a_reference(spark, size):
    """Broadcast shards of any size find what a set of all windows finds."""
    rows, least = corpus(5), 6
    given = [t for i, t in rows if i is not None and i % 3 == 0]
    windows = {tuple(w[s : s + least]) for t in given for w in [re.findall(r"[^\x20\x09-\x0D]+", t or "")] for s in range(len(w) - least + 1)}
    docs = spark.createDataFrame([(i, t, "x", 7) for i, t in rows], "doc_id long, text string, lo string, row int").repartition(3)
    got = {r.doc_id: r.text for r in substring_dedup.against(docs, spark.createDataFrame([(t,) for t in given], "text string"), least, size).collect()}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        gone = {j for s in range(len(w) - least + 1) if tuple(w[s : s + least]) in windows for j in range(s, s + least)}
        assert got[i] == (" ".join(x for j, x in enumerate(w) if j not in gone) if gone else t), i
    assert substring_dedup.against(docs, docs.limit(0).select("text"), least).columns == docs.columns
