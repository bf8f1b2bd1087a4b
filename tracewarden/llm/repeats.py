"""Anchors: which windows of a fixed number of units may occur twice, found in linear work.

Both substring operators ask which windows of W units (bytes or words) occur elsewhere. Texts that
are equal as a whole go on as one, with the least id of their documents and a count; they are
combined before any shuffle, so a text that a third of all rows have costs no more than another. Every
window names an anchor: its k-gram with the least hash, the leftmost among equals. The choice
depends on the window's content alone, so equal windows have equal anchors at equal offsets,
and consecutive windows that share one anchor form a segment: one row for many windows.
Windows can be equal only in segments whose k-grams are equal, so only k-grams seen twice
matter. Their segments are cut out of the text and sent to the group of their k-gram. A segment's
body reaches on to the longest of the wanted lengths, so that longer repeats, which begin
with an equal window, are found in the same group.

A k-gram seen very often would make one very large group. Its segments are cut into narrower
bands of windows first, each grouped by all bytes that the band's windows have in common; at
width one each wanted length is a group of its own, and a group is one string. Groups of such hot
k-grams get one row for each different segment and batch, with its first place and the number of its
places; what is found is joined back to the places by a digest of the segment, a join that adaptive
execution may split. So no task holds the places of a segment that is everywhere.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from hashlib import blake2b
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from tracewarden.llm.shared import joined_bytes, keyed, sliced, written

BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
INVERSE = np.uint64(pow(int(BASE), -1, 2**64))
#: k-grams seen more often are cut into bands of so many windows.
BANDS = ((2_000, 16), (20_000, 1))
#: The width of the bands of all other k-grams: more windows than any segment has.
WHOLE = 1 << 16
#: Different hot segments that a task holds before it sends them on.
HELD_BYTES = 16_000_000
#: Places whose spans a task holds before it sends them on, merged by text.
HELD_PLACES = 4_000
SPLIT = re.compile(rb"[\x20\x09-\x0D]+")
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
_powers: dict[str, np.ndarray] = {}


def mixed(x: np.ndarray) -> np.ndarray:
    """A one-to-one mix of 64-bit values."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x81DADEF4BC2DD44D)
    x ^= x >> np.uint64(33)
    return x


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("up", ())) < n:
        m = max(n, 1 << 20)
        for name, base in (("up", BASE), ("down", INVERSE)):
            full = np.full(m, base, dtype=np.uint64)
            full[0] = 1
            _powers[name] = np.cumprod(full, dtype=np.uint64)
    return _powers["up"][:n], _powers["down"][:n]


def sums(values: np.ndarray) -> np.ndarray:
    """Prefix sums from which ``span_hash`` takes the hash of any span."""
    out = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * powers(len(values))[1], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, a: np.ndarray | slice, b: np.ndarray | slice, up: np.ndarray) -> np.ndarray:
    return (prefix[b] - prefix[a]) * up


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    span = 1
    while span * 2 <= w:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    return np.minimum(x[: len(x) - (w - span)], x[w - span :]) if span < w else x


def words_of(flat: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, and the offset of each text's first word (one more at the end)."""
    dark = ~SPACE[flat]
    lead = dark.copy()
    lead[1:] &= ~dark[:-1]
    cut = offsets[(offsets > 0) & (offsets < len(flat))]
    lead[cut] = dark[cut]
    tail = dark.copy()
    tail[:-1] &= ~dark[1:]
    tail[cut - 1] = dark[cut - 1]
    starts = np.flatnonzero(lead)
    return starts, np.flatnonzero(tail) + 1, np.searchsorted(starts, offsets)


def word_hashes(flat: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    if not len(starts):
        return np.zeros(0, dtype=np.uint64)
    up, _ = powers(len(flat))
    return mixed(span_hash(sums(flat.astype(np.uint64) + np.uint64(1)), starts, ends, up[starts]) + (ends - starts).astype(np.uint64))


def anchors(values: np.ndarray, offsets: np.ndarray, window: int, k: int) -> tuple[np.ndarray, ...]:
    """Segments of texts given as unit values: text number, first window, number of windows, anchor's place from there, k-gram hash."""
    none = np.zeros(0, dtype=np.int64)
    if len(values) < window:
        return none, none, none, none, none
    prefix, n = sums(values), len(values) - k + 1
    gram = mixed(span_hash(prefix, slice(0, n), slice(k, k + n), powers(n)[0]))
    key = (gram & np.uint64(0xFFFFFFFF00000000)) | np.arange(n, dtype=np.uint64)
    place = (sliding_min(key, window - k + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    # windows that would run over the end of their text
    first, last = np.maximum(offsets[:-1], offsets[1:] - window + 1), offsets[1:]
    change = np.zeros(len(values) + 1, dtype=np.int32)
    np.add.at(change, first, 1)
    np.add.at(change, last, -1)
    place[np.cumsum(change)[: len(place)] > 0] = -1
    edge = np.concatenate(([0], np.flatnonzero(place[1:] != place[:-1]) + 1, [len(place)]))
    start, count = edge[:-1], np.diff(edge)
    good = place[start] >= 0
    start, count = start[good], count[good]
    text = np.searchsorted(offsets, start, side="right") - 1
    at = place[start]
    return text, start - offsets[text], count, at - start, gram[at].view(np.int64)


def units(texts: pa.Array, by_word: bool) -> tuple[np.ndarray, np.ndarray, tuple]:
    """Unit values of all texts, the offsets of the texts among them, and (bytes, word starts, word ends)."""
    flat, offsets = joined_bytes(texts)
    if not by_word:
        return flat.astype(np.uint64) + np.uint64(1), offsets, (flat, None, None)
    starts, ends, at = words_of(flat, offsets)
    return word_hashes(flat, starts, ends), at, (flat, starts, ends)


def _find(window: int, k: int, by_word: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in sliced(batch):
                values, offsets, _ = units(part.column("text"), by_word)
                text, start, count, at, gram = anchors(values, offsets, window, k)
                h1, h2 = (part.column(c).to_numpy()[text] for c in ("h1", "h2"))
                packed = start << 32 | count << 16 | at
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (gram, h1, h2, packed)], ["gram", "h1", "h2", "packed"])

    return run


#: A place: the least id of the text's documents, the first unit, and the text's key. Places are in document order.
Place = tuple[int, int, int, int]


def places_of(flat: list[int]) -> list[Place]:
    return list(zip(*[iter(flat)] * 4))


def segment_id(grp: int, at: int, body: bytes) -> tuple[int, int]:
    """128 bits that name a segment."""
    digest = blake2b(body, digest_size=16, key=grp.to_bytes(8, "little", signed=True) + at.to_bytes(4, "little")).digest()
    return int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True)


def _bodies(part: pa.RecordBatch, lengths: tuple[int, ...], by_word: bool) -> Iterator[tuple[int, int, bytes, Place]]:
    """(group, anchor's place in the body, body, place) of each listed segment or band; see the head of this module."""
    window, reach = min(lengths), max(lengths)
    values, offsets, (flat, starts, ends) = units(part.column("text"), by_word)
    raw, prefix = flat.tobytes(), sums(values)

    def body(a: int, b: int) -> bytes:
        return raw[a:b] if not by_word else b" ".join([raw[x:y] for x, y in zip(starts[a:b].tolist(), ends[a:b].tolist())])

    def content(a: int, b: int) -> int:
        return (int(prefix[b]) - int(prefix[a])) * pow(int(BASE), a, 2**64) % 2**64

    for row, (k1, h1, h2, listed) in enumerate(zip(*(part.column(c).to_pylist() for c in ("k1", "h1", "h2", "at")))):
        zero, end = int(offsets[row]), int(offsets[row + 1])
        for gram, packed, width in {(a["gram"], a["packed"], a["width"]) for a in listed}:
            start, count, at = zero + (packed >> 32), packed >> 16 & 0xFFFF, packed & 0xFFFF
            if width == 1:
                for a in range(start, start + count):
                    for length in lengths:
                        if a + length <= end:
                            grp = (content(a, a + length) * 0x9E3779B97F4A7C15 ^ length) % 2**64 - 2**63
                            yield grp, 0, body(a, a + length), (k1, a - zero, h1, h2)
                continue
            for band in range((at - count + 1) // width, at // width + 1):
                i, j = max(0, at - (band + 1) * width + 1), min(count, at - band * width + 1)
                a, b = start + i, min(end, start + j - 1 + reach)
                if a + window > end:
                    continue
                grp = gram
                if width < window:  # what all windows of the band have in common
                    c, d = start + at - band * width, start + at - (band + 1) * width + 1 + window
                    grp = (content(c, d) * 0x9E3779B97F4A7C15 ^ gram % 2**64 ^ band * 0x7FB5D329728EA185) % 2**64 - 2**63
                yield grp, at - i, body(a, b), (k1, a - zero, h1, h2)


def _cut(lengths: tuple[int, ...], by_word: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Each different segment of a slice, with all its places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in sliced(batch):
                found: dict[tuple[int, int, bytes], list[int]] = {}
                for grp, at, body, place in _bodies(part, lengths, by_word):
                    found.setdefault((grp, at, body), []).extend(place)
                yield _segment_rows(found)

    return run


def _segment_rows(found: dict[tuple[int, int, bytes], list[int]], **more: list[int]) -> pa.RecordBatch:
    kinds = {"grp": pa.int64(), "at": pa.int32(), "body": pa.binary()}
    columns = [pa.array([k[i] for k in found], kind) for i, kind in enumerate(kinds.values())]
    return pa.RecordBatch.from_arrays([*columns, pa.array(list(found.values()), pa.list_(pa.int64())), *(pa.array(x, pa.int64()) for x in more.values())], [*kinds, "occ", *more])


def _cut_hot(lengths: tuple[int, ...], by_word: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Each different segment of a run of slices, with its first place and the number of its places."""

    def rows(first: dict, count: dict) -> pa.RecordBatch:
        return _segment_rows({k: list(place) for k, place in first.items()}, places=[count[k] for k in first])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first: dict[tuple[int, int, bytes], Place] = {}
        count: Counter[tuple[int, int, bytes]] = Counter()
        for part in (x for batch in batches for x in sliced(batch)):
            for grp, at, body, place in _bodies(part, lengths, by_word):
                key = grp, at, body
                first[key] = min(first.get(key, place), place)
                count[key] += 1
            if sum(len(body) for _, _, body in first) > HELD_BYTES:
                yield rows(first, count)
                first.clear()
                count.clear()
        yield rows(first, count)

    return run


def _places(lengths: tuple[int, ...], by_word: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The places of each segment of a slice, by the segment's digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in sliced(batch):
                found: dict[tuple[int, int], list[int]] = {}
                for grp, at, body, place in _bodies(part, lengths, by_word):
                    found.setdefault(segment_id(grp, at, body), []).extend(place)
                columns = [pa.array([k[i] for k in found], pa.int64()) for i in (0, 1)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(list(found.values()), pa.list_(pa.int64()))], ["s1", "s2", "occ"])

    return run


class Segments(NamedTuple):
    """What ``segments`` finds.

    docs: every row with its text's key (k1, h1, h2, doc_id or all columns but the text); texts: each
    different text with its key, least id (k1) and copies, with keep also the columns of one of its rows. cold:
    segments with their places (grp, at, body, occ); hot: those of hot k-grams with their first
    place and number (also places); places: all places of hot segments (s1, s2, occ). grp is the group, at the
    anchor's place in the segment, body its bytes, or its words joined by one space, and occ a
    flat list of places.
    """

    docs: DataFrame
    texts: DataFrame
    cold: DataFrame
    hot: DataFrame
    places: DataFrame


KEY = ["h1", "h2"]


def segments(docs: DataFrame, lengths: tuple[int, ...], k: int, by_word: bool, bands: tuple = BANDS, keep: bool = False) -> Segments:
    """All segments that may hold a repeat of the least of ``lengths`` units; bodies reach on to the largest."""
    window = min(lengths)
    rows = keyed(docs, keep=keep).withColumns({"h1": F.xxhash64("text"), "h2": F.xxhash64(F.lit(1), "text")})
    own = ["rest"] if keep else ["doc_id"]
    texts = rows.groupBy(*KEY).agg(F.min("k1").alias("k1"), F.count("*").alias("copies"), *(F.any_value(c).alias(c) for c in (("text", "rest") if keep else ("text",))))
    anchored = "gram long, h1 long, h2 long, packed long"
    # a k-gram counts if two different texts have it, or one text in two places; copies of a text are seen here, but do not make it count
    seen = rows.select("text", *KEY).mapInArrow(_find(window, k, by_word), anchored).groupBy("gram").agg(F.count("*").alias("n"), *(f(c).alias(f"{f.__name__}_{c}") for f in (F.min, F.max) for c in ("h1", "packed")))
    width = F.lit(WHOLE)
    for count, band in bands:
        width = F.when(F.col("n") > count, band).otherwise(width)
    # written, so that both sides of the join are dealt by it and adaptive execution may split hot k-grams
    twice = written(seen.where("min_h1 < max_h1 or min_packed < max_packed").select("gram", width.alias("width")), "twice")
    # all columns of texts go into every step below, so that their exchange is the same and is made once
    found = texts.mapInArrow(_find(window, k, by_word), anchored)
    listed = found.join(twice, "gram").groupBy(*KEY).agg(F.collect_list(F.struct("gram", "packed", "width")).alias("at"))

    def of(hot: bool) -> DataFrame:
        some = F.filter("at", lambda a: (a["width"] < WHOLE) == F.lit(hot))
        return texts.join(listed.withColumn("at", some).where(F.size("at") > 0), KEY)

    occ = "occ array<long>"
    return Segments(
        rows.select("k1", *KEY, *own),
        texts,
        of(False).mapInArrow(_cut(lengths, by_word), f"grp long, at int, body binary, {occ}"),
        of(True).mapInArrow(_cut_hot(lengths, by_word), f"grp long, at int, body binary, {occ}, places long"),
        of(True).mapInArrow(_places(lengths, by_word), f"s1 long, s2 long, {occ}"),
    )


def groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Tables of consecutive rows, cut only where ``key`` changes: rows must come sorted by it."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key).to_numpy(zero_copy_only=False)
        last = int(np.flatnonzero(keys != keys[-1])[-1]) + 1 if keys[0] != keys[-1] else 0
        if held and keys[0] != held[-1].column(key)[-1].as_py():
            yield pa.Table.from_batches(held)
            held = []
        if last:
            yield pa.Table.from_batches([*held, batch.slice(0, last)])
            held = []
        held.append(batch.slice(last))
    if held:
        yield pa.Table.from_batches(held)


class Member(NamedTuple):
    """A segment of a group: places is a flat list of places, of the first alone where ``count`` tells their number."""

    body: bytes
    at: int
    places: list[int]
    count: int


def member_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[Member]]]:
    """Each group with its different segments; rows must come sorted by group. Holds one group's different segments at a time."""
    now, held = None, {}
    for batch in batches:
        hot = "places" in batch.schema.names
        counts = batch.column("places").to_pylist() if hot else [0] * batch.num_rows
        for grp, at, body, occ, n in zip(*(batch.column(c).to_pylist() for c in ("grp", "at", "body", "occ")), counts):
            if grp != now:
                if held:
                    yield now, list(held.values())
                now, held = grp, {}
            old = held.get((body, at))
            if old is None:
                held[body, at] = Member(body, at, occ, n if hot else len(occ) // 4)
            elif hot:
                held[body, at] = Member(body, at, min(old.places, occ), old.count + n)
            else:
                old.places.extend(occ)
                held[body, at] = Member(body, at, old.places, old.count + len(occ) // 4)
    if held:
        yield now, list(held.values())


def sorted_groups(cut: DataFrame) -> DataFrame:
    """Segments dealt out and sorted by group, so that a task streams one group after another."""
    return cut.repartition(F.col("grp")).sortWithinPartitions("grp")


#: Places of a hot segment that its spans are for.
ALL, FIRST, OTHERS = range(3)
Spans = list[tuple[int, int]]
#: Spans of a text, level by level; a level is a list of half-open unit ranges.
Found = dict[tuple[int, int], list[Spans]]


def spans(found: Segments, judge: Callable[[list[Member]], Iterator[tuple[int, list[Spans], list[Spans]]]], levels: int) -> DataFrame:
    """(h1, h2, lo0, hi0, ...) for ``finished`` and ``replaced``.

    ``judge`` gets the members of a group and yields (number of the member, spans in its first place, spans in its other places), level by level, counted from the segment's first unit.
    """
    names = [f"{x}{i}" for i in range(levels) for x in ("lo", "hi")]
    listed = ", ".join(f"{x} array<long>" for x in names)

    def batch_of(keys: list[tuple], rows: list[list[Spans]], key_names: list[str]) -> pa.RecordBatch:
        lists = [pa.array([[x[side] for x in row[level]] for row in rows], pa.list_(pa.int64())) for level in range(levels) for side in (0, 1)]
        return pa.RecordBatch.from_arrays([*(pa.array([k[i] for k in keys], pa.int64()) for i in range(len(key_names))), *lists], [*key_names, *names])

    def add(out: Found, place: Place, own: list[Spans]) -> None:
        held = out.setdefault(place[2:], [[] for _ in range(levels)])
        for into, level in zip(held, own):
            into.extend([(place[1] + a, place[1] + b) for a, b in level])

    def flushed(out: Found) -> pa.RecordBatch:
        rows = [[merged(*zip(*level)) if level else [] for level in own] for own in out.values()]
        return batch_of(list(out), rows, KEY)

    def cold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: Found = {}
        n = 0
        for _, members in member_groups(batches):
            for m, first, rest in judge(members):
                places = sorted(places_of(members[m].places))
                add(out, places[0], first)
                for place in places[1:]:
                    add(out, place, rest)
                n += len(places)
            if n > HELD_PLACES:
                yield flushed(out)
                out, n = {}, 0
        yield flushed(out)

    def hot(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, rows = [], []
        for grp, members in member_groups(batches):
            for m, first, rest in judge(members):
                body, at, place, _ = members[m]
                for which, own in ((ALL, first),) if first == rest else ((FIRST, first), (OTHERS, rest)):
                    if any(own):
                        keys.append((*segment_id(grp, at, body), *place, which))
                        rows.append(own)
            if len(rows) > 10_000:
                yield batch_of(keys, rows, at_first)
                keys, rows = [], []
        yield batch_of(keys, rows, at_first)

    def back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: Found = {}
            for occ, *first, which, own in zip(*(batch.column(c).to_pylist() for c in ("occ", *at_first[2:])), zip(*(batch.column(c).to_pylist() for c in names))):
                own = [list(zip(own[2 * i], own[2 * i + 1])) for i in range(levels)]
                for place in places_of(occ):
                    if which == ALL or which == (FIRST if place == tuple(first) else OTHERS):
                        add(out, place, own)
            yield flushed(out)

    at_first = ["s1", "s2", "f1", "f2", "f3", "f4", "which"]
    told = sorted_groups(found.hot).mapInArrow(hot, ", ".join(f"{x} long" for x in at_first) + ", " + listed)
    one = sorted_groups(found.cold).mapInArrow(cold, f"h1 long, h2 long, {listed}")
    return one.unionByName(found.places.join(told, ["s1", "s2"]).mapInArrow(back, f"h1 long, h2 long, {listed}"))


def _own(batch: pa.RecordBatch, levels: list[str]) -> Iterator[list[Spans]]:
    for own in zip(*(batch.column(c).to_pylist() for c in levels)):
        yield [merged(own[i], own[i + 1]) for i in range(0, len(own), 2)]


def edited(found: Segments, spans_found: DataFrame, edit: Callable, names: list[str], kinds: dict[str, pa.DataType], test: str = "true") -> DataFrame:
    """For the texts that pass the test, the columns ``names`` of ``texts`` and the results of ``edit``, a function of a text as bytes, whether it has copies, and its merged spans level by level.

    ``edit`` returns the result for the first document, and that for the others or None if it is the same; which tells them apart, as in ``ALL``, ``FIRST`` and ``OTHERS``.
    """
    levels = [c for c in spans_found.columns if c not in KEY]
    by_text = spans_found.groupBy(*KEY).agg(*(F.flatten(F.collect_list(c)).alias(c) for c in levels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, at, which = [], [], []
            for n, (text, copies, own) in enumerate(zip(batch.column("text").to_pylist(), batch.column("copies").to_pylist(), _own(batch, levels))):
                first, others = edit(text.encode(), copies > 1, *own)
                same = others is None or copies == 1
                for x, result in ((ALL, first),) if same else ((FIRST, first), (OTHERS, others)):
                    rows.append(result)
                    at.append(n)
                    which.append(x)
            kept = batch.select(names).take(pa.array(at, pa.int64()))
            results = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds.values())]
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(which, pa.int64()), *results], [*names, "which", *kinds])

    some = found.texts.where(test).join(by_text, KEY, "left")
    return some.mapInArrow(run, pa_schema(found.texts.select(*names), kinds))


def pa_schema(df: DataFrame, kinds: dict[str, pa.DataType]) -> StructType:
    told = {pa.int64(): LongType(), pa.string(): StringType()}
    return StructType([*df.schema.fields, StructField("which", LongType()), *(StructField(n, told[k]) for n, k in kinds.items())])


def of_rows(found: Segments, results: DataFrame, out: list[str]) -> DataFrame:
    """The columns ``out`` of every row: results by text are joined to the rows, which adaptive execution may split."""
    results = results.withColumnRenamed("k1", "first").drop(*(c for c in found.docs.columns if c not in (*KEY, "k1")))
    mine = F.col("which") == F.when(F.col("k1") == F.col("first"), FIRST).otherwise(OTHERS)
    return found.docs.join(results, KEY).where((F.col("which") == ALL) | mine).select(*out)


def finished(found: Segments, spans_found: DataFrame, edit: Callable, schema: str) -> DataFrame:
    """doc_id and the results of ``edit`` (see ``edited``), whose columns ``schema`` names."""
    kinds = {x.split()[0]: pa.int64() if x.split()[1] == "long" else pa.string() for x in schema.split(", ")}
    return of_rows(found, edited(found, spans_found, edit, [*KEY, "k1"], kinds), ["doc_id", *kinds])


def replaced(found: Segments, spans_found: DataFrame, edit: Callable) -> DataFrame:
    """The rows that were given (with keep), each with the text that ``edit`` returns (see ``edited``); the text is named text.

    Texts of one row bring that row along, so that only copies are joined to their rows.
    """
    kinds = {"new": pa.string()}
    one = edited(found, spans_found, edit, ["rest"], kinds, "copies = 1").select("rest", "new")
    more = of_rows(found, edited(found, spans_found, edit, [*KEY, "k1"], kinds, "copies > 1"), ["rest", "new"])
    return one.unionByName(more).select("rest.*", F.col("new").alias("text"))


def merged(lo: list[int] | None = None, hi: list[int] | None = None) -> list[tuple[int, int]]:
    """Sorted, disjoint, not touching spans with the same union."""
    out: list[list[int]] = []
    for a, b in sorted(zip(lo or (), hi or ())):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]
