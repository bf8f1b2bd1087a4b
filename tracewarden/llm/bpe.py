"""BPE encoding and decoding: speculate and verify.

Greedy longest match proposes tokens for each distinct word. A sequence of tokens is what the
merge rules give exactly when every adjacent pair is, by itself, what they give for the pair's
bytes; vectorised checks undo merges on both sides of every adjacent pair at once, latest first,
and look for an earlier merge across the border. Only words with a failing pair are merged
exactly. Words and their ids are kept in a bounded cache per worker.

The vocabulary is a byte-level BPE file of the tokenizers library; its path is a parameter.
Nulls count as empty texts, which have no tokens. Added tokens that the file names are cut out of a
text first, as that library does. Very long texts and words are encoded whole; words over
``CACHE_LENGTH`` are not kept. Repeated rows are encoded alike. Empty tables give empty results;
other columns are ignored, whatever their names are.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from array import array
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewarden.llm.shared import sliced

#: Fixed by the vocabulary's kind: how text is cut into words before merging.
WORD = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+")
#: Words kept by a worker, and the longest that are kept.
CACHE, CACHE_LENGTH = 600_000, 64
NEVER = 1 << 60
# white space as the pattern has it: without the four separators that str.isspace adds
DOUBLE, DOUBLE_RUN = re.compile(r"[^\S\x1c-\x1f]{2}"), re.compile(r"([^\S\x1c-\x1f]{2,})")
_loaded: dict[str, "WordCoder"] = {}


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in the file: itself if visible, else the next one after 255."""
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in visible]
    return {chr(b): b for b in visible} | {chr(256 + n): b for n, b in enumerate(hidden)}


def coder(path: str) -> "WordCoder":
    """The coder of a vocabulary, one per worker."""
    if path not in _loaded:
        _loaded[path] = WordCoder(path)
    return _loaded[path]


class WordCoder:
    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        letters, model = byte_letters(), spec["model"]
        raw = lambda s: bytes(map(letters.__getitem__, s))
        self.ids = {raw(s): i for s, i in model["vocab"].items()}
        self.added = {x["content"]: x["id"] for x in spec.get("added_tokens", ())}
        self.split_added = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        size = max([*self.ids.values(), *self.added.values()]) + 1
        self.bytes: list[bytes] = [b""] * size
        for b, i in self.ids.items():
            self.bytes[i] = b
        for s, i in self.added.items():
            self.bytes[i] = s.encode()
        self.base = [self.ids[bytes([b])] for b in range(256)]
        # age: 0 for bytes, else one more than the merge's rank; a token's parts are those of its first merge
        self.merge: dict[tuple[int, int], tuple[int, int]] = {}
        self.age = np.zeros(size, dtype=np.int64)
        self.head, self.tail = np.arange(size), np.arange(size)
        for rank, pair in enumerate(model["merges"]):
            a, b = (raw(x) for x in (pair.split(" ") if isinstance(pair, str) else pair))
            x, y, new = self.ids[a], self.ids[b], self.ids[a + b]
            self.merge[x, y] = (rank + 1, new)
            if not self.age[new]:
                self.age[new], self.head[new], self.tail[new] = rank + 1, x, y
        keys = np.array([x << 32 | y for x, y in self.merge], dtype=np.int64)
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], np.array([r for r, _ in self.merge.values()], dtype=np.int64)[order]
        self.rank = {x << 32 | y: r for (x, y), (r, _) in self.merge.items()}
        self.made = {r: new for r, new in self.merge.values()}
        self.proposals = {b: i for b, i in self.ids.items() if len(b) == 1 or self.age[i] and self.exact(b) == [i]}
        # the longest proposal that starts with each pair of bytes: no longer match is tried
        self.reach: dict[bytes, int] = {}
        for b in self.proposals:
            self.reach[b[:2]] = max(self.reach.get(b[:2], 0), len(b))
        self.byte_ranks = [self.rank.get(a << 32 | b, NEVER) for a in self.base for b in self.base]
        self.ranked = None
        self.words: dict[str, bytes] = {}
        self.cache: dict[str, bytes] = {}
        self.spaced: dict[str, bytes] = {}
        self.n_exact = self.n_words = 0

    def exact(self, word: bytes) -> list[int]:
        """Applies the merges in order of rank, the leftmost of equals first."""
        ids = [self.base[b] for b in word]
        n = len(ids)
        after, before = [*range(1, n + 1)], [*range(-1, n - 1)]
        merge = self.merge
        heap = [(merge[pair][0], i, pair) for i, pair in enumerate(zip(ids, ids[1:])) if pair in merge]
        heapq.heapify(heap)
        while heap:
            _, i, pair = heapq.heappop(heap)
            j = after[i] if ids[i] == pair[0] else n
            if j >= n or ids[j] != pair[1]:
                continue
            ids[i], ids[j] = merge[pair][1], -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (new := (ids[i], ids[k])) in merge:
                    heapq.heappush(heap, (merge[new][0], i, new))
            h = before[i]
            if h >= 0 and (new := (ids[h], ids[i])) in merge:
                heapq.heappush(heap, (merge[new][0], h, new))
        return [x for x in ids if x >= 0]

    def exact_short(self, word: bytes) -> list[int]:
        """The same for short words: looks for the first of the earliest merges in a list of ranks."""
        base, byte_ranks, rank, made = self.base, self.byte_ranks, self.rank.get, self.made
        ids = [base[b] for b in word]
        ranks = [byte_ranks[a << 8 | b] for a, b in zip(word, word[1:])]
        while ranks and (least := min(ranks)) != NEVER:
            i = ranks.index(least)
            ids[i] = new = made[least]
            del ids[i + 1], ranks[i]
            if i:
                ranks[i - 1] = rank(ids[i - 1] << 32 | new, NEVER)
            if i < len(ranks):
                ranks[i] = rank(new << 32 | ids[i + 1], NEVER)
        return ids

    def propose(self, word: bytes) -> list[int]:
        known, reach, n, at, out = self.proposals.get, self.reach.get, len(word), 0, []
        token = known(word)
        if token is not None:
            return [token]
        while at < n:
            end = min(n, at + reach(word[at : at + 2], 1))
            token = known(word[at:end])
            while token is None:  # a single byte is always known
                end -= 1
                token = known(word[at:end])
            out.append(token)
            at = end
        return out

    def rank_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of the merge of each pair; a very large number where there is none."""
        key = a << 32 | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], 1 << 60)

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the bytes of each pair of tokens are encoded as just that pair.

        Undoes the younger of the two tokens step by step. A merge across the border wins if it
        comes before the merge that was undone last; of equal ranks the left one comes first, so
        a merge across ties in favour of the border only against the right token's parts.
        """
        good = np.ones(len(a), dtype=bool)
        live = np.arange(len(a))
        a, b = a.copy(), b.copy()
        limit = np.full(len(a), 1 << 59, dtype=np.int64)
        while len(live):
            bad = self.rank_of(a, b) < limit
            good[live[bad]] = False
            age_a, age_b = self.age[a], self.age[b]
            on = ~bad & ((age_a > 0) | (age_b > 0))
            live, a, b, age_a, age_b = live[on], a[on], b[on], age_a[on], age_b[on]
            left = age_a > age_b
            limit = np.where(left, age_a, age_b + 1)
            a, b = np.where(left, self.tail[a], a), np.where(left, b, self.head[b])
        return good

    def learn(self, words: Iterable[str]) -> None:
        """Encodes words into the cache."""
        words = list(words)
        proposed = [self.propose(w.encode()) for w in words]
        size = np.fromiter(map(len, proposed), dtype=np.int64, count=len(words))
        flat = np.fromiter((t for p in proposed for t in p), dtype=np.int64, count=int(size.sum()))
        ends = np.cumsum(size)
        inner = np.ones(len(flat), dtype=bool)
        inner[ends - 1] = False
        at = np.flatnonzero(inner)
        pairs, which = np.unique(flat[at] << 32 | flat[at + 1], return_inverse=True)
        fine = self.compatible(pairs >> 32, pairs & 0xFFFFFFFF)[which]
        failing = set(np.searchsorted(ends, at[~fine], side="right").tolist())
        self.n_words += len(words)
        self.n_exact += len(failing)
        for n, (word, ids) in enumerate(zip(words, proposed)):
            raw = word.encode()
            self.words[word] = array("I", (self.exact_short(raw) if len(raw) < 48 else self.exact(raw)) if n in failing else ids).tobytes()

    def pieces(self, text: str) -> tuple[list[list[str]], list[tuple[str, ...]]]:
        """Lines of a text, each cut at single spaces, and what is left as words of their own.

        A word of the pattern starts at every single space between visible characters, and a
        single line feed between them is a word; so the parts between can be cut, and kept,
        one by one. Returns runs of parts and the words that stand between the runs.
        """
        if not DOUBLE.search(text):
            lines = text.split("\n")
            return [x.split(" ") for x in lines], [("\n",)] * (len(lines) - 1)
        runs, between = [], []
        rest = DOUBLE_RUN.split(text)
        lead = ""
        for n, part in enumerate(rest):
            if n % 2:
                if n + 2 == len(rest) and not rest[-1]:
                    between.append((part,))
                    lead = ""
                    runs.append([""])
                    return runs, between
                lead = part[-1]
                between.append((part[:-1],) if lead == " " else (part[:-1], lead))
            else:
                lines = part.split("\n")
                runs += [x.split(" ") for x in lines]
                if lead == " ":
                    runs[-len(lines)].insert(0, "")
                between += [("\n",)] * (len(lines) - 1)
        return runs, between

    def encoded(self, texts: list[str]) -> Iterator[bytes]:
        """The ids of each text as little-endian unsigned 32-bit numbers."""
        cut = [[x for x in self.split_added.split(t) if x] if self.split_added and any(s in t for s in self.added) else [t] for t in texts]
        known, spaced = self.cache, self.spaced
        plans, first, later = [], set(), set()
        for parts in cut:
            plan = []
            for x in parts:
                if x in self.added:
                    plan.append(x)
                else:
                    runs, between = self.pieces(x)
                    for run in runs:
                        first.add(run[0])
                        if len(run) > 1:
                            later.update(islice(run, 1, None))
                    for words in between:
                        first.update(words)
                    plan.append((runs, between))
            plans.append(plan)
        if len(known) + len(spaced) + len(first) + len(later) > CACHE:
            known.clear()
            spaced.clear()
        first = [x for x in first if x not in known]
        later = [x for x in later if x not in spaced]
        words = [[*map(WORD.findall, first)], [WORD.findall(" " + x) for x in later]]
        if len(self.words) > CACHE:
            self.words.clear()
        self.learn({w for part in words for run in part for w in run}.difference(self.words))
        get = self.words.__getitem__
        for to, names, part in ((known, first, words[0]), (spaced, later, words[1])):
            for x, run in zip(names, part):
                to[x] = b"".join(map(get, run))
        get, get_spaced = known.__getitem__, spaced.__getitem__
        for plan in plans:
            out = []
            for x in plan:
                if isinstance(x, str):
                    out.append(self.added[x].to_bytes(4, "little"))
                    continue
                runs, between = x
                for run, words in zip(runs, [*between, ()]):
                    out.append(get(run[0]))
                    out += map(get_spaced, islice(run, 1, None))
                    out += map(get, words)
            yield b"".join(out)
        for to in (known, spaced, self.words):
            for x in [x for x in (*first, *later) if len(x) > CACHE_LENGTH]:
                to.pop(x, None)

    def encoded_by_rank(self, texts: list[str], longest: int = 100_000) -> Iterator[bytes]:
        """The same ids from a compiled coder that merges by rank, for callers that need ids only.

        Longer texts go through ``encoded``, whose work is linear in runs without spaces.
        """
        if self.ranked is None:
            import tiktoken

            pattern = WORD.pattern.replace(r"\P{White_Space}", r"\S").replace(r"[^\p{White_Space}", r"[^\s").replace(r"\p{White_Space}", r"\s")
            self.ranked = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=self.ids, special_tokens={}).encode_ordinary
        for text in texts:
            if len(text) > longest or any(s in text for s in self.added):
                yield next(self.encoded([text]))
            else:
                yield array("I", self.ranked(text)).tobytes()

    def decoded(self, ids: Iterable[int]) -> str:
        return b"".join(map(self.bytes.__getitem__, ids)).decode(errors="replace")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and the ids of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(path or default_path())
        for batch in batches:
            for part in sliced(batch):
                ids = [np.frombuffer(x, dtype="<u4").astype(np.int32) for x in own.encoded(part.column("text").to_pylist())]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return texts_of(docs).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and the text of each row of ids; null ids give null, unknown bytes the replacement character."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(path or default_path())
        for batch in batches:
            texts = [None if ids is None else own.decoded(ids) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(run, "doc_id long, text string")


def texts_of(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, and the SHA-256 of the ids and of the decoded text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(path or default_path())
        name = [str(i) for i in range(len(own.bytes))].__getitem__
        sha = lambda b: hashlib.sha256(b).hexdigest()
        for batch in batches:
            for part in sliced(batch):
                rows = []
                for packed in own.encoded(part.column("text").to_pylist()):
                    ids = np.frombuffer(packed, dtype="<u4").tolist()
                    rows.append((len(ids), sha(",".join(map(name, ids)).encode()), sha(own.decoded(ids).encode())))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), *(pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.string(), pa.string())))],
                    ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    return texts_of(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
