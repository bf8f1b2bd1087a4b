"""Substring dedup: matching statistics of documents against suffix automata of reference shards.

``against`` holds documents to a reference of its own: the reference is cut into shards of a stated
size, and one shard's automaton after another is broadcast and every document streamed through it.
A corpus that is its own reference would need a pass over itself for each of its shards, so
``digests`` and ``cleaned`` make other shards. There a shard is one anchor group (see ``repeats``): all
places where a repeated window with this anchor can be. The shard's automaton holds the reference, that is the segments that come
first in document order; each later segment is streamed through it, which gives for every word the
length of the longest match that ends there, and is then added to it. Words in matches
of the threshold or more are spans to remove. The automata are routed to the segments that can
match them, together in one shuffle, since their total size grows with the corpus.

Nulls count as texts without words; very long texts are cut into segments like all others. Windows
of rows that share an id and a text are one document's. Empty tables give empty results; other
columns are ignored, or kept by ``cleaned``, whatever their names are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewarden.llm import repeats
from tracewarden.llm.shared import written

GRAM = 7
#: As ``repeats.BANDS``, in windows of words: a segment has some seven.
BANDS = ((2_000, 3), (20_000, 1))


class SuffixAutomaton:
    """Of strings of hashable symbols, grown symbol by symbol."""

    def __init__(self) -> None:
        self.step: list[dict] = [{}]
        self.link, self.length, self.last = [-1], [0], 0

    def add(self, symbol) -> None:
        step, link, length = self.step, self.link, self.length
        new, p = len(step), self.last
        step.append({})
        length.append(length[p] + 1)
        link.append(0)
        while p >= 0 and symbol not in step[p]:
            step[p][symbol] = new
            p = link[p]
        if p >= 0:
            q = step[p][symbol]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                twin = len(step)
                step.append(dict(step[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and step[p].get(symbol) == q:
                    step[p][symbol] = twin
                    p = link[p]
                link[q] = link[new] = twin
        self.last = new

    def matches(self, symbols: list) -> Iterator[int]:
        """For each symbol, the length of the longest match that ends with it."""
        step, link, length = self.step, self.link, self.length
        state = size = 0
        for x in symbols:
            while state and x not in step[state]:
                state = link[state]
                size = length[state]
            to = step[state].get(x)
            if to is not None:
                state, size = to, size + 1
            yield size


def _judge(least: int):
    """For ``repeats.spans``: words in a window of ``least`` words that also starts earlier."""

    def run(members: list[repeats.Member]) -> Iterator[tuple[int, list, list]]:
        order = sorted(range(len(members)), key=lambda m: min(repeats.places_of(members[m].places)))
        shard = SuffixAutomaton()
        for n, m in enumerate(order):
            words = members[m].body.split(b" ")
            ends = [j for j, size in enumerate(shard.matches(words), 1) if size >= least] if n else []
            first = repeats.merged([j - least for j in ends], ends)
            if first or members[m].count > 1:
                yield m, [first], [[(0, len(words))]]
            if n + 1 < len(order):
                for word in words:
                    shard.add(word)
                shard.add(n)

    return run


def _edit(text: bytes, spans: list[tuple[int, int]]) -> tuple:
    words = [w for w in repeats.SPLIT.split(text) if w]
    kept, at = [], 0
    for a, b in spans:
        kept += words[at:a]
        at = b
    kept += words[at:]
    return len(words), sum(b - a for a, b in spans), kept


def spans_by_text(docs: DataFrame, least: int = 20, gram: int = GRAM, bands: tuple = BANDS, keep: bool = False) -> tuple[repeats.Segments, DataFrame]:
    """(segments, spans) for ``repeats.finished``."""
    found = repeats.segments(docs, (least,), min(gram, least // 2), by_word=True, bands=bands, keep=keep)
    return found, repeats.spans(found, _judge(least), 1)


def digests(docs: DataFrame, least: int = 20, **how) -> DataFrame:
    """doc_id, n_words, n_removed and the SHA-256 of the kept words, joined by one space."""

    def edit(text: bytes, copied: bool, spans: list[tuple[int, int]]) -> tuple:
        n, gone, kept = _edit(text, spans)
        first = n, gone, hashlib.sha256(b" ".join(kept)).hexdigest()
        return first, (n, n, hashlib.sha256(b"").hexdigest()) if n >= least else None  # all words of later copies stand earlier

    return repeats.finished(*spans_by_text(docs, least, **how), edit, "n_words long, n_removed long, kept_sha256 string")


def cleaned(docs: DataFrame, least: int = 20, **how) -> DataFrame:
    """``docs`` with the kept words of each text, joined by one space. All columns stay."""

    def edit(text: bytes, copied: bool, spans: list[tuple[int, int]]) -> tuple:
        n, _, kept = _edit(text, spans)
        return (b" ".join(kept).decode(),), ("",) if n >= least else None

    return repeats.replaced(*spans_by_text(docs, least, keep=True, **how), edit).select(docs.columns)


def oracle_sql(least: int = 20) -> str:
    """``digests`` as DuckDB SQL: every window of every text, numbered among its equals in document order."""
    return rf"""
    WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
    g AS (SELECT doc_id, i, md5(array_to_string(ws[i:i + {least - 1}], ' ')) AS s FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - {least - 2})) AS i FROM w)),
    d AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS r FROM g) WHERE r > 1),
    c AS (SELECT doc_id, list(DISTINCT p) AS gone FROM (SELECT doc_id, unnest(range(i, i + {least})) AS p FROM d) GROUP BY 1),
    k AS (SELECT w.doc_id, ws, coalesce(gone, []) AS gone FROM w LEFT JOIN c ON c.doc_id = w.doc_id),
    x AS (SELECT doc_id, string_agg(ws[p], ' ' ORDER BY p) AS kept FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS p FROM w) u WHERE NOT EXISTS (SELECT 1 FROM (SELECT doc_id AS e, unnest(gone) AS q FROM c) z WHERE z.e = u.doc_id AND z.q = u.p) GROUP BY 1)
    SELECT k.doc_id, len(ws)::BIGINT AS n_words, len(gone)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM k LEFT JOIN x ON x.doc_id = k.doc_id"""


#: Words of a reference shard; its automaton has at most twice as many states, and is what is broadcast.
SHARD_WORDS = 100_000


def _shards(reference: DataFrame, least: int, size: int) -> Iterator[SuffixAutomaton]:
    """Automata of the reference's texts, ``size`` words each. The driver holds one shard; a text that is cut goes on with the last ``least`` - 1 words in the next."""
    shard, held, n = SuffixAutomaton(), 0, 0
    for row in reference.select("text").where("text is not null").toLocalIterator():
        words = [w for w in repeats.SPLIT.split(row["text"].encode()) if w]
        at = 0
        while len(words) - at >= least:
            part = words[at : at + max(least, size - held)]
            for word in part:
                shard.add(word)
            n, held = n + 1, held + len(part)
            shard.add(n)  # a number is no word: no match goes on past it
            at += len(part) - (least - 1)
            if held >= size:
                yield shard
                shard, held = SuffixAutomaton(), 0
    if held:
        yield shard


def against(docs: DataFrame, reference: DataFrame, least: int = 20, shard_words: int = SHARD_WORDS) -> DataFrame:
    """``docs`` without the words in windows of ``least`` words that stand in a text of ``reference`` (text) too, joined by one space; texts that lose none stay as they are.

    One pass over the documents for each shard, written before the next; what is broadcast is one shard's automaton, whose size ``shard_words`` bounds. Null texts stay null.
    """
    spark, kind = docs.sparkSession, docs.schema
    state = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("body"), *(F.array().cast("array<long>").alias(c) for c in ("lo", "hi")))
    for shard in _shards(reference, least, shard_words):
        held = spark.sparkContext.broadcast((shard.step, shard.link, shard.length))

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            own = SuffixAutomaton()
            own.step, own.link, own.length = held.value
            for batch in batches:
                lows, highs = [], []
                for text, lo, hi in zip(*(batch.column(c).to_pylist() for c in ("body", "lo", "hi"))):
                    ends = [j for j, size in enumerate(own.matches([w for w in repeats.SPLIT.split(text.encode()) if w]), 1) if size >= least]
                    whole = repeats.merged([*lo, *(j - least for j in ends)], [*hi, *ends])
                    lows.append([a for a, _ in whole])
                    highs.append([b for _, b in whole])
                yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("body"), *(pa.array(x, pa.list_(pa.int64())) for x in (lows, highs))], ["row", "body", "lo", "hi"])

        state = written(state.mapInArrow(run, state.schema), "matched")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("body", "lo", "hi")))
            new = [b" ".join(_edit(text.encode(), list(zip(lo, hi)))[2]).decode() if lo else None for text, lo, hi in rows]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(new, pa.string())], ["row", "new"])

    done = state.mapInArrow(finish, state.select("row").withColumn("new", F.lit(None).cast("string")).schema)
    return done.select(*((F.coalesce("new", "row.text") if c == "text" else F.col(f"row.`{c}`")).alias(c) for c in kind.names))
