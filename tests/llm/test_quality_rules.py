"""Quality rules against plain Python."""

import random
import re
from collections import Counter

import duckdb
import pytest

from tracewarden.llm import quality_rules


def plain(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    n = Counter(windows)
    covered = {j for i, w in enumerate(windows) if n[w] > 1 for j in range(i, i + 3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def test_figures(spark):
    r = random.Random(2)
    texts = [None, "", " ", "a", "a b", "a b c", "a a a a", "a b a b a b", "x\nx\n x\n\n\nx ", "#*$%&|<> é🙂 #", "\x1c\x85 \x0bk\x0c"]
    texts += [" ".join(r.choice("abcdef") for _ in range(r.randint(0, 60))).replace("a b", "a\nb") for _ in range(300)]
    texts += ["w " * 5000 + " ".join(map(str, range(5000)))]
    docs = spark.createDataFrame([(i, t, f"s{i % 3}", 1) for i, t in enumerate(texts)], "doc_id long, text string, source string, host int")
    for r in quality_rules.verdicts(docs).collect():
        assert tuple(r[1:6]) == plain(texts[r.doc_id]), texts[r.doc_id]
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.kept and r.base_failed)


def test_hosts(spark):
    good, bad = " ".join(f"w{i}" for i in range(60)), "spam"
    rows = [(i, good, f"ok{i % 9}") for i in range(400)] + [(1000 + i, bad if i % 10 else good, "farm") for i in range(100)] + [(2000, good, None), (2000, good, None), (2001, bad, "tiny")]
    docs = spark.createDataFrame([(*x, True, "h", 5.0, 7) for x in rows], "doc_id long, text string, source string, base_failed boolean, host string, rate double, k2 int")
    got = {r.doc_id: r.kept for r in quality_rules.verdicts(docs).collect()}
    kept = quality_rules.filtered(docs)
    assert kept.columns == docs.columns and sorted((r.doc_id, r.source) for r in kept.collect()) == sorted((i, s) for i, t, s in rows if got[i])
    assert not got[1000] and not got[1010] and got[0] and got[2000] and not got[2001]
    assert quality_rules.verdicts(docs).count() == len(rows) and quality_rules.verdicts(docs.limit(0)).count() == 0


@pytest.mark.parametrize("failed", [0, 9])
def test_one_host(spark, failed):
    rows = spark.createDataFrame([("h", *[i < failed] * 5) for i in range(10)], "host string, " + ", ".join(f"{x} boolean" for x in quality_rules.RULES))
    row = quality_rules.host_verdicts(rows).first()
    assert row.host_rate == pytest.approx(failed / 10) and not row.host_rejected and row.host_rule is None


def test_hosts_are_rejected_by_rules_that_spare_documents(spark):
    """Good documents by the base rules: hosts full of symbols, of repeated lines or of long words go, also if one holds a third of all rows."""
    prose = lambda i: " ".join(f"w{(i * 7 + j * (i % 5 + 1)) % 997}" for j in range(80))
    rows = [(i, prose(i), f"ok{i % 12}") for i in range(480)]
    rows += [(1000 + i, prose(i) + " # $ % & | < > # $ %", "symbols") for i in range(300)]
    rows += [(2000 + i, "\n".join([" ".join(f"w{i}x{j}y{k}" for k in range(6)) for j in range(14)] + ["see more"] * 8), "lines") for i in range(60)]
    rows += [(3000 + i, prose(i).replace("w", "averyverylongword"), "long") for i in range(60)]
    rows += [(4000, prose(1) + " # $ % & | < > # $ %", "small")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = quality_rules.verdicts(docs).collect()
    assert not any(r.base_failed for r in got)
    rules = {r.doc_id // 1000: r.host_rule for r in got}
    assert rules == {0: None, 1: "symbols", 2: "dup_lines", 3: "word_length", 4: None}
    assert {r.doc_id for r in got if not r.kept} == {r[0] for r in rows if 1000 <= r[0] < 4000}


def test_verdicts_against_sql(spark, data_dir):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{data_dir}/documents.parquet'")
    result = con.execute(quality_rules.oracle_sql())
    names = [c[0] for c in result.description]
    got = quality_rules.verdicts(spark.read.parquet(f"{data_dir}/documents.parquet"))
    assert got.columns == names and sorted(map(tuple, got.collect()), key=str) == sorted(result.fetchall(), key=str)
