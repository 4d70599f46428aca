"""Benchmark decontamination by Wu-Manber multi-pattern search.

A pattern is a window of consecutive item words between blanks. Texts are brought to the same form (A-Z lower-cased,
words parted by single blanks) and scanned by block shift tables: the block that ends a search window tells how far the
window may move; at a shift of 0 the block's hash selects a bucket of patterns, and bytes are compared directly. Many
stretches of a batch are scanned at once, each with a shift of its own. Patterns are grouped by length, so that a
short one doesn't shorten the shifts of the others.

Rows are mapped without shuffle. The test set travels to the executors in blocks of a bounded number of bytes, one
pass over the documents for each block; its size is measured first.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm import base

WINDOW = 10
#: Bytes of item text that one pass looks for.
TEST_SET_BYTES = 2 << 20
#: Least lengths of the groups of patterns, bytes of a stretch, slots of a shift table.
LENGTHS, STRETCH, SLOTS = (3, 8, 16, 32), 4096, 1 << 18
#: Bytes of a pattern that the tables and the first comparison use.
HEAD = 64
#: 0-9, a-z and all above 0x7F make words; A-Z become a-z.
FORM = bytes(x + 32 if 65 <= x <= 90 else x if 48 <= x <= 57 or 97 <= x <= 122 or x >= 128 else 32 for x in range(256))
#: Never in a text of that form.
BORDER = b"A"


def formed(text: bytes) -> bytes:
    return text.translate(FORM)


def loads(b: np.ndarray) -> np.ndarray:
    """The 8 bytes from each position, as little-endian integers; b ends with 7 bytes of padding."""
    return np.ndarray((len(b) - 7,), "<u8", b.data, 0, (1,))


class Group:
    """Patterns of similar length and their shift table."""

    def __init__(self, patterns: list[bytes], numbers: list[int]):
        self.patterns, self.numbers, self.sizes = patterns, np.asarray(numbers), np.array([len(p) for p in patterns])
        self.least = m = min(HEAD, int(self.sizes.min()))
        self.block = min(8, m // 2 + 1)
        self.mask = np.uint64((1 << 8 * self.block) - 1)
        self.bytes = np.zeros((len(patterns), min(HEAD, int(self.sizes.max()))), np.uint8)
        for i, p in enumerate(patterns):
            self.bytes[i, : len(p)] = np.frombuffer(p[:HEAD], np.uint8)
        heads = np.concatenate([np.ascontiguousarray(self.bytes[:, :m]).reshape(-1), np.zeros(8, np.uint8)])
        far = m - self.block + 1
        self.shifts = np.full(SLOTS, far, np.int64)
        rows = np.arange(len(patterns)) * m
        for j in range(far):  # the last offset of a block counts
            self.shifts[self.slot(loads(heads)[rows + j])] = far - 1 - j
        slots = self.slot(loads(heads)[rows + far - 1])
        order = np.argsort(slots, kind="stable")
        self.order, self.at = order, np.searchsorted(slots[order], np.arange(SLOTS + 1))

    def slot(self, block: np.ndarray) -> np.ndarray:
        return ((block & self.mask) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(46)).astype(np.int64)

    def find(self, text: bytes, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(pattern number, position) of all occurrences in text; b is its bytes and padding."""
        n = len(text)
        words, m = loads(b), self.least
        at = np.arange(0, max(n, 1), STRETCH)
        end = np.minimum(at + STRETCH, n - m + 1)
        places, slots = [], []
        while True:
            going = at < end
            if not going.all():
                at, end = at[going], end[going]
            if not len(at):
                break
            slot = self.slot(words[at + m - self.block])
            shift = self.shifts[slot]
            hit = shift == 0
            if hit.any():
                places.append(at[hit])
                slots.append(slot[hit])
            at = at + np.maximum(shift, 1)
        if not places:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        place, slot = np.concatenate(places), np.concatenate(slots)
        many = self.at[slot + 1] - self.at[slot]
        place, first = np.repeat(place, many), np.repeat(self.at[slot] - np.concatenate([[0], np.cumsum(many)[:-1]]), many)
        row = self.order[first + np.arange(len(place))]
        found = []
        for i in range(0, len(place), 1 << 14):
            p, r = place[i : i + (1 << 14)], row[i : i + (1 << 14)]
            fits = p + self.sizes[r] <= n
            p, r = p[fits], r[fits]
            where = p[:, None] + np.arange(self.bytes.shape[1])[None]
            same = (b[np.minimum(where, n)] == self.bytes[r]) | (np.arange(self.bytes.shape[1])[None] >= self.sizes[r][:, None])
            good = same.all(1)
            for j in np.flatnonzero(good & (self.sizes[r] > HEAD)):
                at = int(p[j])
                good[j] = text.startswith(self.patterns[r[j]], at)
            found.append((self.numbers[r[good]], p[good]))
        return np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found])


class Searcher:
    def __init__(self, patterns: list[bytes]):
        """patterns: distinct, each of 3 bytes at least."""
        self.groups = []
        for low, high in zip(LENGTHS, [*LENGTHS[1:], 1 << 62], strict=True):
            if some := [(p, i) for i, p in enumerate(patterns) if low <= len(p) < high]:
                self.groups.append(Group([p for p, _ in some], [i for _, i in some]))

    def find(self, text: bytes) -> tuple[np.ndarray, np.ndarray]:
        b = np.frombuffer(text + b"A" * (HEAD + 8), np.uint8)
        found = [g.find(text, b) for g in self.groups]
        none = np.zeros(0, np.int64)
        return np.concatenate([none, *[x for x, _ in found]]), np.concatenate([none, *[x for _, x in found]])


class Windows:
    """The windows of items: patterns, and the items and words of each."""

    def __init__(self, items: list[tuple[str | None, str | None]], window: int):
        of: dict[bytes, set[str]] = {}
        self.words = []
        for item, text in items:
            w = formed((text or "").encode("utf-8", "surrogatepass")).split()
            for i in range(max(1, len(w) - window + 1) if w else 0):
                of.setdefault(b" " + b" ".join(w[i : i + window]) + b" ", set()).add(str(item))
        self.items = list(of.values())
        self.words = np.array([p.count(b" ") - 1 for p in of], np.int64)
        self.searcher = Searcher(list(of)) if of else None


@lru_cache(4)
def windows(items: tuple, window: int) -> Windows:
    return Windows(list(items), window)


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, word starts, first word of each text and the end): all texts in one, words parted by single blanks."""
    raw = np.frombuffer(b" " + (b" " + BORDER + b" ").join(map(formed, texts)) + b" " + BORDER + b" ", np.uint8)
    blank = raw == 32
    keep = ~blank
    keep[0] = True
    keep[1:] |= ~blank[:-1]
    b = raw[keep]
    starts = np.flatnonzero(b[:-1] == 32) + 1
    borders = b[starts] == BORDER[0]
    firsts = np.concatenate([[0], np.cumsum(~borders)[borders]])
    return b, starts[~borders], firsts


def search(docs: DataFrame, items: list[tuple[str | None, str | None]], window: int, names: list[str], earlier: bool, keep: list[str]) -> DataFrame:
    """One pass over docs of columns names and, if earlier, what former passes found: n_words, spans (word ranges as
    pairs of 64-bit integers) and items. Returns the columns keep and these three."""
    shared = docs.sparkSession.sparkContext.broadcast(tuple(items))
    place = {c: i for i, c in enumerate(names)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = windows(shared.value, window)
        for batch in batches:
            texts = base.utf8(batch.column(place["text"]))
            for a, e in base.chunks(texts):
                b, starts, firsts = joined(texts[a:e])
                which, where = known.searcher.find(b.tobytes()) if known.searcher else (np.zeros(0, np.int64),) * 2
                word = np.searchsorted(starts, where + 1)
                doc = np.searchsorted(firsts, word, "right") - 1
                order = np.argsort(doc, kind="stable")
                which, word, doc = which[order], word[order], doc[order]
                at = np.searchsorted(doc, np.arange(e - a + 1))
                old = batch.slice(a, e - a)
                spans, titles = [], []
                for i in range(e - a):
                    some = which[at[i] : at[i + 1]]
                    s = word[at[i] : at[i + 1]] - firsts[i]
                    pairs = np.stack([s, s + known.words[some]], 1) if len(some) else np.zeros((0, 2), np.int64)
                    got = set().union(*(known.items[j] for j in set(some.tolist())))
                    if earlier:
                        pairs = np.concatenate([np.frombuffer(old.column(len(names) + 1)[i].as_py(), "<i8").reshape(-1, 2), pairs])
                        got |= set(old.column(len(names) + 2)[i].as_py())
                    spans.append(merged(pairs).astype("<i8").tobytes())
                    titles.append(sorted(got))
                out = [*[old.column(place[c]) for c in keep], pa.array(np.diff(firsts)), pa.array(spans, pa.binary()), pa.array(titles, pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays(out, names=[*keep, "n_words", "spans", "items"])

    kinds = [f"`{c}` {docs.schema[place[c]].dataType.simpleString()}" for c in keep]
    return docs.mapInArrow(run, ", ".join([*kinds, "n_words long", "spans binary", "items array<string>"]))


def merged(pairs: np.ndarray) -> np.ndarray:
    """Ranges in order, those that touch or overlap joined."""
    if len(pairs) < 2:
        return pairs
    pairs = pairs[np.argsort(pairs[:, 0], kind="stable")]
    ends = np.maximum.accumulate(pairs[:, 1])
    new = np.concatenate([[True], pairs[1:, 0] > ends[:-1]])
    at = np.flatnonzero(new)
    return np.stack([pairs[at, 0], ends[np.concatenate([at[1:] - 1, [len(pairs) - 1]])]], 1)


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, test_set_bytes: int = TEST_SET_BYTES, keep: list[str] | None = None) -> DataFrame:
    """docs: doc_id, text; benchmark: item_id, text. Returns the columns keep of docs (doc_id if not given), n_words, spans (ranges of hit words), items (ids of
    items with occurring windows, sorted as strings), a row for each row of docs. Null texts have no words; an empty
    benchmark hits nothing; repeated items count as one; a null item_id is the item 'None'."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text")
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-size // test_set_bytes))
    keep = keep or ["doc_id"]
    names = [*dict.fromkeys([*keep, "text"])]
    out = docs.select(names)
    for i in range(blocks):
        block = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == i).distinct().collect()
        out = search(out, sorted((tuple(x) for x in block), key=str), window, names, i > 0, keep if i == blocks - 1 else names)
    return out


def digests(found: DataFrame) -> DataFrame:
    """The contract's columns, from contamination()."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hit = [int(np.diff(np.frombuffer(x, "<i8").reshape(-1, 2), axis=1).sum()) for x in batch.column("spans").to_pylist()]
            items = batch.column("items").to_pylist()
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), batch.column("n_words"), pa.array(hit, pa.int64()), pa.array([len(x) for x in items], pa.int64()),
                pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in items], pa.string()), pa.array([x > 0 for x in hit], pa.bool_()),
            ], names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"])

    kind = found.schema["doc_id"].dataType.simpleString()
    return found.mapInArrow(run, f"doc_id {kind}, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean")


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(contamination(base.table(spark, sf_dir, "documents"), base.table(spark, sf_dir, "benchmark")))


def oracle() -> str:
    words = r"list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"
    run = lambda n: f"array_to_string(w[i:i + {n} - 1], ' ')"
    return f"""with d as (select doc_id, {words} w from documents), b as (select item_id, {words} w from benchmark),
p as (select distinct item_id, len(w) n, array_to_string(w, ' ') p from b where len(w) between 1 and {WINDOW} union select item_id, {WINDOW}, {run(WINDOW)} from (select *, unnest(range(1, len(w) - {WINDOW} + 2)) i from b where len(w) > {WINDOW})),
n as (select distinct n from p),
g as (select doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') p from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) i from d, n where len(w) >= n)),
h as (select doc_id, i, n, item_id from g join p using (n, p)),
k as (select doc_id, count(distinct i + j)::bigint n_hit from (select doc_id, i, unnest(range(0, n)) j from h) group by 1),
t as (select doc_id, count(*)::bigint n_items, sha256(string_agg(item_id, ',' order by item_id)) items_sha256 from (select distinct doc_id, item_id::varchar item_id from h) group by 1)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items, coalesce(items_sha256, sha256('')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join k using (doc_id) left join t using (doc_id)"""
