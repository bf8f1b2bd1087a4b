"""Suffix-array dedup: maximal repeats from the common-prefix interval trees of enhanced suffix arrays.

Each anchor group (see ``repeats``) is one sparse enhanced suffix array: the suffixes that start
at the group's anchor, sorted, with the common-prefix lengths of neighbours. A stack scan
visits the intervals of its common-prefix tree. Within an interval the texts to the left of the
anchor are sorted too and scanned likewise; a cluster whose left extensions differ and whose
members come from more than one child interval is a maximal repeat, with all its occurrences
and not just neighbours. Identical suffixes count once, with a weight.

Nulls count as empty texts; texts shorter than the threshold stay as they are; very long ones are
cut into segments like all others; repeated rows are repeats of each other; empty tables give
empty results; other columns are ignored, or kept by ``cleaned``, whatever their names are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from tracewarden.llm import repeats

GRAM = 64
#: Passages: runs of repeated strings of so many bytes, with more than so many words. Fifty words of running text are longer.
PASSAGE_BYTES, PASSAGE_WORDS = 240, 50


def common(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    return n - ((int.from_bytes(a[:n]) ^ int.from_bytes(b[:n])).bit_length() + 7) // 8


def intervals(lcp: list[int]) -> Iterator[tuple[int, int, int]]:
    """(common length, first, last + 1) of each inner node, children first. lcp[j]: of places j - 1 and j; lcp[0] is not read."""
    stack: list[tuple[int, int]] = []
    for j in range(1, len(lcp) + 1):
        value, left = (lcp[j] if j < len(lcp) else -1), j - 1
        while stack and stack[-1][0] > value:
            depth, left = stack.pop()
            yield depth, left, j
        if not stack or stack[-1][0] < value:
            stack.append((value, left))


def maximal_repeats(members: list[tuple[bytes, int]], least: int) -> Iterator[tuple[int, list[tuple[int, int]]]]:
    """(length, [(member, start)]) of the repeats of ``least`` bytes or more around the anchors of different strings (bytes, anchor's place)."""
    right = [body[at:] for body, at in members]
    left = [body[:at][::-1] for body, at in members]
    order = sorted(range(len(members)), key=right.__getitem__)
    lcp = [0, *(common(right[a], right[b]) for a, b in zip(order, order[1:]))]
    deepest = max(at for _, at in members)
    for depth, a, b in intervals(lcp):
        if depth + deepest < least:
            continue
        child, own = {}, 0
        for j in range(a, b):
            own += j > a and lcp[j] == depth
            child[order[j]] = own
        by_left = sorted(order[a:b], key=left.__getitem__)
        back = [0, *(common(left[x], left[y]) for x, y in zip(by_left, by_left[1:]))]
        if max(back) + depth < least:
            continue
        for more, c, d in intervals(back):
            if depth + more >= least and any(child[m] != child[by_left[c]] for m in by_left[c + 1 : d]):
                yield depth + more, [(m, members[m][1] - more) for m in by_left[c:d]]


def _judge(least: int, wide: int):
    """For ``repeats.spans``: level 0 has the bytes in repeats of ``wide`` bytes or more, level 1 those in repeats of ``least`` or more."""

    def run(members: list[repeats.Member]) -> Iterator[tuple[int, list, list]]:
        found: list[list[tuple[int, int]]] = [[(0, len(m.body))] if m.count > 1 else [] for m in members]
        if len(members) > 1:
            for length, where in maximal_repeats([(m.body, m.at) for m in members], least):
                for m, start in where:
                    found[m].append((start, start + length))
        for m, own in enumerate(found):
            if own:
                levels = [repeats.merged(*zip(*some)) if (some := [x for x in own if x[1] - x[0] >= n]) else [] for n in (wide, least)]
                yield m, levels, levels

    return run


def repeat_groups(docs: DataFrame, least: int = 400, gram: int = GRAM) -> DataFrame:
    """The maximal repeats themselves: grp long, length int, and occurrences of (doc key, start), per anchor group.

    A repeat that reaches beyond one anchor's windows is reported in one piece per anchor. Texts that are equal as
    a whole count once, under their least id. Segments of
    k-grams that are seen more often than the first of ``repeats.BANDS`` are told with their first
    place and the number of places, by ``places``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("doc_id", pa.int64()), ("start", pa.int64())]))
        for grp, members in repeats.member_groups(batches):
            where = [[p[:2] for p in repeats.places_of(m.places)] for m in members]
            out = [(len(m.body), w, m.count) for m, w in zip(members, where) if m.count > 1]
            for length, found in maximal_repeats([(m.body, m.at) for m in members], least) if len(members) > 1 else ():
                out.append((length, [(k1, start + s) for m, s in found for k1, start in where[m]], sum(members[m].count for m, _ in found)))
            yield pa.RecordBatch.from_arrays(
                [pa.array([grp] * len(out), pa.int64()), pa.array([x[0] for x in out], pa.int32()), pa.array([[{"doc_id": a, "start": b} for a, b in x[1]] for x in out], kind), pa.array([x[2] for x in out], pa.int64())],
                ["grp", "length", "occurrences", "places"],
            )

    found = repeats.segments(docs, (least,), min(gram, least // 2), by_word=False)
    schema = "grp long, length int, occurrences array<struct<doc_id: long, start: long>>, places long"
    return repeats.sorted_groups(found.cold).mapInArrow(run, schema).unionByName(repeats.sorted_groups(found.hot).mapInArrow(run, schema))


def _kept(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    out, at = [], 0
    for a, b in spans:
        out.append(text[at:a])
        at = b
    out.append(text[at:])
    return b"".join(out)


def passages(text: bytes, spans: list[tuple[int, int]], words: int = PASSAGE_WORDS) -> list[tuple[int, int]]:
    """The spans with more than ``words`` words or parts of words."""
    return [(a, b) for a, b in spans if sum(1 for w in repeats.SPLIT.split(text[a:b]) if w) > words]


def spans_by_text(docs: DataFrame, least: int = 400, passage: int = PASSAGE_BYTES, gram: int = GRAM, bands: tuple = repeats.BANDS, keep: bool = False) -> tuple[repeats.Segments, DataFrame]:
    """(segments, spans) for ``repeats.finished``: level 0 at ``least`` bytes, level 1 at ``passage`` bytes (which is not above ``least``)."""
    passage = min(passage, least)
    found = repeats.segments(docs, tuple(sorted({passage, least})), min(gram, passage // 2), by_word=False, bands=bands, keep=keep)
    return found, repeats.spans(found, _judge(passage, least), 2)


def _with_copies(text: bytes, copied: bool, spans: list, least: int) -> list:
    """A text that other rows have too is one repeat, if it is long enough."""
    return [(0, len(text))] if copied and len(text) >= least else spans


def digests(docs: DataFrame, least: int = 400, passage: int = PASSAGE_BYTES, words: int = PASSAGE_WORDS, **how) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and the SHA-256 of what is left of each document; n_passages and n_passage_bytes.

    The last two are of maximal runs of bytes that are each in a string of ``passage`` bytes which
    also starts elsewhere, as far as they have more than ``words`` words. They remove nothing.
    """

    def edit(text: bytes, copied: bool, spans: list, more: list) -> tuple:
        spans = _with_copies(text, copied, spans, least)
        told = passages(text, _with_copies(text, copied, more, min(passage, least)), words)
        return (len(text), sum(b - a for a, b in spans), len(spans), hashlib.sha256(_kept(text, spans)).hexdigest(), len(told), sum(b - a for a, b in told)), None

    return repeats.finished(*spans_by_text(docs, least, passage, **how), edit, "n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_passages long, n_passage_bytes long")


def cleaned(docs: DataFrame, least: int = 400, words: int | None = None, passage: int = PASSAGE_BYTES, **how) -> DataFrame:
    """``docs`` with what is left of each text; a character that a span cuts through goes whole. All columns stay.

    words: passages of more words, as in ``digests``, go too.
    """
    passage = least if words is None else min(passage, least)

    def edit(text: bytes, copied: bool, spans: list, more: list) -> tuple:
        spans, more = _with_copies(text, copied, spans, least), _with_copies(text, copied, more, passage)
        gone = spans if words is None else repeats.merged(*zip(*spans, *passages(text, more, words)))
        return (_kept(text, gone).decode(errors="ignore"),), None

    return repeats.replaced(*spans_by_text(docs, least, passage, keep=True, **how), edit).select(docs.columns)


def oracle_sql(least: int = 400, passage: int = PASSAGE_BYTES, words: int = PASSAGE_WORDS) -> str:
    """``digests`` as DuckDB SQL: every window of every text in hexadecimal, counted by its MD5, and the union of those seen twice."""

    def spans(name: str, size: int) -> str:
        return f"""g{name} AS (SELECT doc_id, i, md5_number(substr(h, 2 * i + 1, {2 * size})) AS s FROM (SELECT doc_id, h, unnest(range(0, len(h) // 2 - {size - 1})) AS i FROM d)),
    q{name} AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY s) AS n FROM g{name}) WHERE n > 1),
    u{name} AS (SELECT doc_id, i, CASE WHEN i - lag(i) OVER v <= {size} THEN 0 ELSE 1 END AS fresh FROM q{name} WINDOW v AS (PARTITION BY doc_id ORDER BY i)),
    s{name} AS (SELECT doc_id, min(i) AS a, max(i) + {size} AS b FROM (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM u{name}) GROUP BY doc_id, run)"""

    white = "['20', '09', '0A', '0B', '0C', '0D']"
    return f"""
    WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
    {spans('w', least)},
    {spans('p', passage)},
    k AS (SELECT doc_id, sum(b - a) AS gone, count(*) AS spans, list({{'a': a, 'b': b}} ORDER BY a) AS l FROM sw GROUP BY 1),
    m AS (SELECT sp.doc_id, b - a AS size, regexp_extract_all(substr(h, 2 * a + 1, 2 * (b - a)), '..') AS x FROM sp JOIN d ON d.doc_id = sp.doc_id),
    t AS (SELECT doc_id, count(*) AS n, sum(size) AS bytes FROM (SELECT doc_id, size, len(list_filter(range(1, len(x) + 1), lambda j: NOT list_contains({white}, x[j]) AND (j = 1 OR list_contains({white}, x[j - 1])))) AS n_words FROM m) WHERE n_words > {words} GROUP BY 1)
    SELECT d.doc_id, (len(h) // 2)::BIGINT AS n_bytes, coalesce(gone, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans,
      sha256(unhex(CASE WHEN l IS NULL THEN h ELSE array_to_string(list_transform(range(0, len(l) + 1), lambda j: substr(h, CASE WHEN j = 0 THEN 1 ELSE 2 * l[j].b + 1 END, CASE WHEN j = len(l) THEN len(h) ELSE 2 * l[j + 1].a - CASE WHEN j = 0 THEN 0 ELSE 2 * l[j].b END END)), '') END)) AS kept_sha256,
      coalesce(t.n, 0)::BIGINT AS n_passages, coalesce(t.bytes, 0)::BIGINT AS n_passage_bytes
    FROM d LEFT JOIN k ON k.doc_id = d.doc_id LEFT JOIN t ON t.doc_id = d.doc_id"""
