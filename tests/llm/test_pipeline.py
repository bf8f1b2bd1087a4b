"""The pipeline: stages take effect, on small planted cases and as a whole."""

import random
import re
import statistics
from collections import Counter

import corpus_pipeline
import public_tokenizers
import tokenizers
from pyspark.sql import functions as F

from tests.llm.test_ngram_join import brute as near_brute
from tests.llm.test_pii import plain as pii_plain
from tests.llm.test_quality_rules import plain as quality_plain
from tests.llm.test_repeats import covered
from tracewarden.llm import pii

WORDS = [f"term{i}" for i in range(900)]


def prose(a, n):
    return " ".join(WORDS[(a * 37 + i * (a % 7 + 1)) % 900] + str(a) for i in range(n))


def test_stages(spark, data_dir):
    passage = "a passage that repeats across documents and is long enough to be found " * 6
    rows = [(i, prose(i, 120), "en", "good", 0) for i in range(30)]
    rows += [(100, rows[3][1], "en", "good", 0), (101, rows[3][1] + " tail", "en", "good", 0), (102, "spam " * 5, "en", "good", 0), (103, None, "en", None, 0)]
    rows += [(200 + i, prose(50 + i, 80) + "\n" + passage + "\n" + prose(70 + i, 20), "en", "good", 0) for i in range(3)]
    rows += [(300, prose(99, 90) + " mail me@site.org now", None, None, None), (None, prose(98, 90), "en", "good", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    a = corpus_pipeline.quality(spark, docs, data_dir)
    assert a.columns == docs.columns and {r.doc_id for r in a.collect()} == {r[0] for r in rows} - {102, 103}
    b = corpus_pipeline.near_duplicates(spark, a, data_dir)
    assert {r.doc_id for r in b.collect()} == {r[0] for r in rows} - {100, 101, 102, 103}
    c = corpus_pipeline.repeated_passages(spark, b, data_dir)
    texts = {r.doc_id: r.text for r in c.collect()}
    assert c.columns == docs.columns and texts[5] == rows[5][1] and "passage that repeats" not in texts[201] and "term" in texts[201]
    d = corpus_pipeline.personal_data(spark, c, data_dir)
    row = d.where("doc_id = 300").first()
    assert d.schema.names == docs.columns and "<EMAIL>" in row.text and row.n_chars == len(row.text) and row.lang is None
    e = corpus_pipeline.packed(spark, d, data_dir)
    assert e.select("doc_id").distinct().count() == d.count()


def test_run(spark, data_dir):
    got = corpus_pipeline.run(spark, data_dir)
    assert got.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 1024").isEmpty() and not got.isEmpty()


def brute_quality(rows):
    """The rows that the quality rules keep, each host judged by plain arithmetic over all hosts."""
    figures = []
    for row in rows:
        n, chars, symbols, dup, repeat = quality_plain(row[1])
        lines = sum(bool(re.search(r"[^\x20\x09-\x0D]", x)) for x in (row[1] or "").split("\n"))
        figures.append((n < 50, 100 * repeat > 50 * n, symbols > 0.1 * n, dup > 0.3 * lines, chars < 3 * n or chars > 12 * n))
    hosts = {}
    for row, fails in zip(rows, figures):
        hosts.setdefault(row[3], []).append(fails)
    bad = set()
    for rule in range(5):
        rates = {h: sum(f[rule] for f in own) / len(own) for h, own in hosts.items()}
        mean = sum(rates.values()) / len(rates)
        spread = statistics.variance(rates.values()) - mean * (1 - mean) * sum(1 / len(own) for own in hosts.values()) / len(hosts)
        weight = max(1.0, min(1000.0, mean * (1 - mean) / max(1e-9, spread) - 1))
        for h, own in hosts.items():
            q = (rates[h] * len(own) + mean * weight) / (len(own) + weight)
            low = q - 2 * (q * (1 - q) / (len(own) + weight + 1)) ** 0.5
            if low > 3 * mean and low > 0.25:
                bad.add(h)
    return [row for row, fails in zip(rows, figures) if not fails[0] and not fails[1] and row[3] not in bad]


def brute_near(rows):
    found = near_brute([r[:2] for r in rows if r[0] is not None])
    return [r for r in rows if r[0] is None or found[r[0]][2]]


def brute_passages(rows):
    texts = [(r[1] or "").encode() for r in rows]
    out = []
    for row, b, wide, more in zip(rows, texts, covered(texts, 400), covered(texts, 240)):
        gone = bytearray(wide)
        for m in re.finditer(b"\1+", more):
            if len(re.findall(rb"[^\x20\x09-\x0D]+", b[m.start() : m.end()])) > 50:
                gone[m.start() : m.end()] = b"\1" * (m.end() - m.start())
        out.append((row[0], bytes(x for x, g in zip(b, gone) if not g).decode(errors="ignore"), *row[2:]))
    return out


def brute_private(rows):
    out = []
    for row in rows:
        spans = sorted([(a, k, b, kind) for k, (a, b, kind) in enumerate(pii_plain(row[1]))] + [(s.start, 99, s.end, s.kind) for s in pii.find(row[1]) if s.kind not in pii.BASE_KINDS])
        text, at = "", 0
        for a, _, b, kind in spans:
            text += row[1][at:a] + f"<{kind.upper()}>" if a >= at else ""
            at = max(at, b)
        out.append((row[0], text + row[1][at:], *row[2:]))
    return out


def test_against_brute_force(spark, data_dir, tmp_path):
    """Every stage on its own input, then the whole: real documents, planted copies, near copies, passages, a bad host and clashing columns."""
    r = random.Random(3)
    docs = spark.read.parquet(f"{data_dir}/documents.parquet").orderBy("doc_id")
    rows = [tuple(x) for x in docs.select("doc_id", "text", "lang", "source", "n_chars").collect()]
    words = sorted({w for x in rows for w in (x[1] or "").split()})[:4000]
    text = lambda n: " ".join(r.choices(words, k=n))
    passage = " ".join(w for w in words if len(w) < 6)[:330]
    assert len(passage.split()) > 50
    rows += [(10_000 + i, rows[i][1], "en", "copies", 0) for i in range(12)]
    for i in range(12):
        w = text(150).split()
        rows.append((11_000 + 2 * i, " ".join(w), "en", "near", 0))
        w[r.randrange(150)] = "changed"
        rows.append((11_001 + 2 * i, " ".join(w), "en", "near", 0))
    rows += [(12_000 + i, f"{text(70)} {passage} {text(70)}", "en", "shared", 0) for i in range(6)]
    rows += [(13_000 + i, text(80) + " # $ % & | < > # $ % & | < >", "en", "farm", 0) for i in range(40)]
    rows += [(14_000, text(20_000), "en", "long", 0), (14_001, None, None, None, None), (14_002, "", "en", None, 0), (None, text(60) + " a@b.org", "en", "none", 0), (14_003, text(60), "en", "near", 0), (14_003, text(60), "en", "near", 0)]
    frame = spark.createDataFrame([(*x, i, "x", 0.5) for i, x in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long, k1 long, host string, kept double").repartition(5)
    plain = lambda df: sorted(((x.doc_id, x.text, x.lang, x.source) for x in df.collect()), key=str)
    expected = rows
    for (_, stage), brute in zip(corpus_pipeline.STAGES[:4], (brute_quality, brute_near, brute_passages, brute_private)):
        expected, done = brute(expected), stage(spark, frame, data_dir)
        assert done.columns == frame.columns
        assert plain(done) == sorted((x[:4] for x in expected), key=str)
        done.write.parquet(str(tmp_path / stage.__name__))
        frame = spark.read.parquet(str(tmp_path / stage.__name__))
    ids = {x[0] for x in expected}
    assert len(ids & set(range(13_000, 13_040))) == 0 and len(ids & set(range(11_000, 11_024))) == 12 and not ids & set(range(10_000, 10_012))
    assert not any(passage[5:-5] in x[1] for x in expected)
    coder = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    lengths = Counter({k: 0 for k in ids})
    for x in expected:
        lengths[x[0]] += len(coder.encode(x[1], add_special_tokens=False).ids) + 1
    got, sequences = Counter(), {}
    for p in corpus_pipeline.packed(spark, frame, data_dir).collect():
        got[p.doc_id] += p.length
        sequences.setdefault(p.sequence_id, []).append((p.offset, p.length))
    assert got == lengths
    for own in sequences.values():
        ends = [a + n for a, n in sorted(own)]
        assert [a for a, _ in sorted(own)] == [0, *ends[:-1]] and ends[-1] <= 1024
    assert len(sequences) <= -(-sum(lengths.values()) // 1024) * 1.02 + 1


def test_empty(spark, data_dir):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, data_dir)
        assert out.count() == 0 and (name == "packing" or out.columns == docs.columns)
