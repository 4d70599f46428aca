"""Removal of repeated byte strings across documents with a run-length index.

Every string of `length` bytes has an anchor: the smallest hash among its substrings of ANCHOR bytes. Equal strings
have equal anchors, so consecutive strings with one anchor, a context, can be dealt by it, and no task needs the whole
corpus. Documents form groups of about GROUP_BYTES by hash.

1. Each group sends its distinct (anchor, context hash, smallest document) to the anchors' tasks, packed. So a context
   that a third of all documents have is one entry of each group.
2. An anchor's task tells each group which contexts an earlier document has whole: those are marked. Contexts of which
   the group has the first copy, and that have a different neighbour under their anchor, must be compared byte by byte.
3. The group sends these contexts once each, and their task builds a run-length index of them, streams their matching
   statistics through it and marks each string whose block has a smaller owner. An anchor with more than VARIANTS
   different contexts would gather in one task; its strings are dealt one by one, by their own hash.
4. Marks return to their group, where documents are cut.

Everything is determined by content, so lost tasks can be run again anywhere. The exchange of texts by group is the
same for all steps and Spark reuses it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm import base, shingles
from lattica.llm.suffix_index import RunLengthIndex

LENGTH, ANCHOR = 50, 24
#: Bytes of text of a group and of an index; strings of a context; different contexts of an anchor.
GROUP_BYTES, INDEX_BYTES, CONTEXT, VARIANTS = 8 << 20, 1 << 20, 64, 1024
NOBODY = np.iinfo(np.int64).max
KEPT, COPY, SHIP, DEAL = 0, 1, 2, 3
SENT = "bucket int, g int, anchors binary, contexts binary, owners binary, several binary"
TOLD = "g int, bucket int, status binary"
SHIPPED = "to int, g int, keys binary, rows binary, owners binary, starts binary, sizes binary, bytes binary"
MARKED = "g int, marks binary"
RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def contexts(texts: list[bytes], length: int, anchor: int) -> dict[str, np.ndarray]:
    """Contexts of some texts: anchor and context hashes, text number, first string's start, number of strings."""
    ends = np.cumsum([0, *map(len, texts)])
    n = int(ends[-1])
    names = ("anchor", "hash", "doc", "start", "count")
    if n < length:
        return dict(zip(names, (np.zeros(0, np.uint64), np.zeros(0, np.uint64), *(np.zeros(0, np.int64),) * 3), strict=True))
    b = np.frombuffer(b"".join(texts), np.uint8)
    power, inverse = shingles.powers(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((b.astype(np.uint64) + np.uint64(1)) * power[:n], out=total[1:])
    m = base.mix((total[anchor:] - total[:-anchor]) * inverse[: n - anchor + 1])
    wide, span = length - anchor + 1, 1
    while 2 * span <= wide:
        m = np.minimum(m[:-span], m[span:])
        span *= 2
    if span < wide:
        m = np.minimum(m[: len(m) - (wide - span)], m[wide - span :])
    cross = np.zeros(n + 1, np.int32)  # strings that would begin in one text and end in another
    np.add.at(cross, np.maximum(ends[1:] - (length - 1), ends[:-1]), 1)
    np.add.at(cross, ends[1:], -1)
    inside = np.cumsum(cross)[: len(m)] == 0
    new = np.ones(len(m), bool)
    new[1:] = (m[1:] != m[:-1]) | (inside[1:] != inside[:-1])
    begin = ends[:-1][ends[:-1] < len(m)]
    new[begin] = True
    first = np.flatnonzero(new)
    size = np.diff(np.concatenate([first, [len(m)]]))
    if size.max() > CONTEXT:  # repetitive text: pieces of bounded length
        parts = -(-size // CONTEXT)
        shift = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        first, size = np.repeat(first, parts) + CONTEXT * shift, np.minimum(CONTEXT, np.repeat(size, parts) - CONTEXT * shift)
    first, size = first[inside[first]], size[inside[first]]
    doc = np.searchsorted(ends, first, "right") - 1
    end = first + size + length - 1
    code = base.mix(((total[end] - total[first]) * inverse[first]) ^ (size.astype(np.uint64) * np.uint64(shingles.BASE)))
    return dict(zip(names, (m[first], code, doc, first - ends[doc], size), strict=True))


class Group:
    """The documents of a group in order of id (null last) and text, their contexts, and these by distinct content."""

    def __init__(self, table: pa.Table, length: int, anchor: int, buckets: int):
        ids = [NOBODY if x is None else x for x in table.column("doc_id").to_pylist()]
        rows = sorted(zip(ids, base.utf8(table.column("text")), strict=True))
        self.ids, self.texts = np.array([i for i, _ in rows], np.int64), [t for _, t in rows]
        found = []
        for a, b in base.chunks(self.texts, 1 << 20):
            part = contexts(self.texts[a:b], length, anchor)
            part["doc"] = part["doc"] + a
            found.append(part)
        self.anchor, self.hash, self.doc, self.start, self.count = (np.concatenate([p[k] for p in found]) if found else np.zeros(0, np.int64) for k in ("anchor", "hash", "doc", "start", "count"))
        content = base.mix(self.anchor.astype(np.uint64) + np.uint64(shingles.BASE) * self.hash.astype(np.uint64))
        bucket = (self.anchor % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(content)
        new = np.concatenate([[True], content[order][1:] != content[order][:-1]]) if len(order) else np.zeros(0, bool)
        number = np.cumsum(new) - 1
        self.of = np.empty(len(order), np.int64)  # each context's content
        self.of[order] = number
        at = np.flatnonzero(new)
        self.first = np.minimum.reduceat(order, at) if len(at) else order  # the content's first context: of its smallest document
        self.owner = self.ids[self.doc[self.first]] if len(at) else np.zeros(0, np.int64)
        self.several = np.maximum.reduceat(self.ids[self.doc[order]], at) != self.owner if len(at) else np.zeros(0, bool)
        self.bucket = bucket[self.first] if len(at) else np.zeros(0, np.int64)
        self.sorted = np.argsort(self.bucket.astype(np.uint16) if buckets <= 1 << 16 else self.bucket, kind="stable")
        self.buckets = np.unique(self.bucket)
        self.at = np.searchsorted(self.bucket[self.sorted], [*self.buckets, buckets])

    def parts(self) -> Iterator[tuple[int, np.ndarray]]:
        """(bucket, its contents)."""
        for i, b in enumerate(self.buckets.tolist()):
            yield b, self.sorted[self.at[i] : self.at[i + 1]]


def planes(x: np.ndarray) -> bytes:
    """Bytes by place value: equal high bytes lie together, which compresses."""
    return np.ascontiguousarray(x).view(np.uint8).reshape(len(x), -1).T.tobytes()


def from_planes(x: bytes, kind: str) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(x, np.uint8).reshape(width, -1).T).view(kind).reshape(-1)


def send(table: pa.Table, length: int, anchor: int, buckets: int) -> pa.Table:
    group, g = Group(table, length, anchor, buckets), table.column("g")[0].as_py()
    tag = (group.anchor // np.uint64(buckets) & np.uint64(0xFFFFFFFF)).astype("<u4")
    out = [(b, g, planes(tag[group.first[x]]), planes(group.hash[group.first[x]].astype("<u8")), planes(group.owner[x]), np.packbits(group.several[x]).tobytes()) for b, x in group.parts()]
    return table_of(out, SENT)


def table_of(rows: list[tuple], schema: str) -> pa.Table:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "string": pa.string()}
    fields = [x.split() for x in schema.split(", ")]
    return pa.table({name: pa.array([r[i] for r in rows], kinds[kind]) for i, (name, kind) in enumerate(fields)})


def compare(table: pa.Table, most: int = VARIANTS) -> pa.Table:
    """An anchor bucket: what each group is to do with its contents."""
    anchors, hashes, owners = ([from_planes(x.as_py(), k) for x in table.column(c)] for c, k in (("anchors", "<u4"), ("contexts", "<u8"), ("owners", "<i8")))
    several = np.concatenate([np.unpackbits(np.frombuffer(x.as_py(), np.uint8), count=len(a)) for x, a in zip(table.column("several"), anchors, strict=True)]).astype(bool)
    sizes = [len(a) for a in anchors]
    anchor, code, owner = np.concatenate(anchors), np.concatenate(hashes), np.concatenate(owners)
    order = np.lexsort((code, anchor))
    a, c, o = anchor[order], code[order], owner[order]
    new_a = np.concatenate([[True], a[1:] != a[:-1]])
    new_c = new_a | np.concatenate([[True], c[1:] != c[:-1]])
    of_a, of_c = np.cumsum(new_a) - 1, np.cumsum(new_c) - 1
    at = np.flatnonzero(new_a)
    shared = (np.minimum.reduceat(o, at) != np.maximum.reduceat(o, at)) | np.logical_or.reduceat(several[order], at)
    variants = np.bincount(of_a, new_c).astype(np.int64)
    first = np.minimum.reduceat(o, np.flatnonzero(new_c))
    copy = o > first[of_c]
    mixed = (shared & (variants > 1))[of_a]
    status = np.empty(len(order), np.uint8)
    status[order] = np.where(copy, COPY, np.where(mixed, np.where(variants[of_a] > most, DEAL, SHIP), KEPT))
    out, i = [], 0
    for g, n in zip(table.column("g").to_pylist(), sizes, strict=True):
        part = status[i : i + n]
        if part.any():
            out.append((g, table.column("bucket")[0].as_py(), part.tobytes()))
        i += n
    return table_of(out, TOLD)


def marks(rows: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> bytes:
    return np.stack([rows, starts, sizes]).astype("<u4").tobytes()


def ship(table: pa.Table, told: pa.Table, length: int, anchor: int, buckets: int) -> pa.Table:
    """Marks of copies (to: -1), and contexts that have to be compared."""
    if not table.num_rows:
        return table_of([], SHIPPED)
    group, g = Group(table, length, anchor, buckets), table.column("g")[0].as_py()
    status = np.zeros(len(group.first), np.uint8)
    by_bucket = dict(zip(told.column("bucket").to_pylist(), told.column("status"), strict=True))
    for b, x in group.parts():
        if b in by_bucket:
            status[x] = np.frombuffer(by_bucket[b].as_py(), np.uint8)
    mine = status[group.of] if len(status) else np.zeros(0, np.uint8)
    later = group.ids[group.doc] > group.owner[group.of] if len(status) else np.zeros(0, bool)
    copy = np.flatnonzero((mine == COPY) | later)
    out = [(g % buckets, g, None, None, None, None, None, marks(group.doc[copy], group.start[copy], group.count[copy] + length - 1))]
    whole, single = np.flatnonzero((mine == SHIP) & ~later), np.flatnonzero((mine == DEAL) & ~later)
    doc, start, size, key = group.doc[whole], group.start[whole], group.count[whole] + length - 1, group.anchor[whole]
    if len(single):
        many = group.count[single]
        at = np.repeat(group.start[single], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        of = np.repeat(group.doc[single], many)
        keys = np.array([int.from_bytes(hashlib.blake2b(group.texts[d][s : s + length], digest_size=8).digest(), "little") for d, s in zip(of.tolist(), at.tolist(), strict=True)], np.uint64)
        # A string that several documents of the group have goes once, for the first; it marks the others.
        o = np.lexsort((group.ids[of], keys))
        first = np.concatenate([[True], keys[o][1:] != keys[o][:-1]])
        least = np.repeat(group.ids[of[o[first]]], np.diff(np.concatenate([np.flatnonzero(first), [len(o)]])))
        repeat = o[group.ids[of[o]] > least]
        out.append((g % buckets, g, None, None, None, None, None, marks(of[repeat], at[repeat], np.full(len(repeat), length))))
        rest = o[group.ids[of[o]] == least]
        doc, start, key = np.concatenate([doc, of[rest]]), np.concatenate([start, at[rest]]), np.concatenate([key, keys[rest]])
        size = np.concatenate([size, np.full(len(rest), length)])
    to = (base.mix(key) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(to, kind="stable")
    cut = np.flatnonzero(np.concatenate([[True], to[order][1:] != to[order][:-1]])) if len(order) else []
    for x in np.split(order, cut[1:]) if len(order) else []:
        text = b"".join([group.texts[d][s : s + n] for d, s, n in zip(doc[x].tolist(), start[x].tolist(), size[x].tolist(), strict=True)])
        out.append((int(to[x[0]]), g, key[x].astype("<u8").tobytes(), doc[x].astype("<u4").tobytes(), planes(group.ids[doc[x]]), start[x].astype("<u4").tobytes(), size[x].astype("<u2").tobytes(), text))
    return table_of(out, SHIPPED)


def repeated(texts: np.ndarray, starts: np.ndarray, sizes: np.ndarray, owners: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(text number, position) of the strings that a text of a smaller owner has too."""
    index = RunLengthIndex(texts, starts, owners, length)
    which, where = [], []
    for number, position, matched, row in index.stream(texts, starts, index.ends):
        long = np.flatnonzero(matched >= length)
        if len(long):
            hit = long[index.smallest_owner(row[long]) < owners[number[long]]]
            which.append(number[hit])
            where.append(position[hit])
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *which]), np.concatenate([none, *where])


def index_and_mark(table: pa.Table, length: int) -> pa.Table:
    """Contexts of one bucket of keys: marks for the groups they came from. Marks of copies pass."""
    out, rows = [], []
    for i, (g, keys, body) in enumerate(zip(table.column("g").to_pylist(), table.column("keys"), table.column("bytes"), strict=True)):
        if keys.as_py() is None:
            out.append((g, body.as_py()))
        else:
            rows.append(i)
    if not rows:
        return table_of(out, MARKED)
    some = table.take(pa.array(rows))
    field = lambda c, kind: [np.frombuffer(x.as_py(), kind) for x in some.column(c)]
    keys, docs, starts, sizes = np.concatenate(field("keys", "<u8")), np.concatenate(field("rows", "<u4")), np.concatenate(field("starts", "<u4")), np.concatenate(field("sizes", "<u2")).astype(np.int64)
    owners = np.concatenate([from_planes(x.as_py(), "<i8") for x in some.column("owners")])
    group = np.repeat(np.array(some.column("g").to_pylist()), [len(x.as_py()) // 8 for x in some.column("keys")])
    text = np.frombuffer(b"".join(x.as_py() for x in some.column("bytes")), np.uint8)
    at = np.cumsum(sizes) - sizes
    order = np.argsort(keys, kind="stable")
    # Keys are never parted; a batch of them is an index.
    new = np.flatnonzero(np.concatenate([[True], keys[order][1:] != keys[order][:-1]]))
    used = np.cumsum(np.add.reduceat(sizes[order], new)) // INDEX_BYTES
    cut = new[np.flatnonzero(np.diff(used, prepend=-1))]
    found: dict[int, list] = {}
    for x in np.split(order, cut[1:]):
        n = sizes[x]
        begin = np.cumsum(n) - n
        gather = np.repeat(at[x] - begin, n) + np.arange(n.sum())
        which, where = repeated(text[gather], begin, n, owners[x], length)
        for g in np.unique(group[x[which]]) if len(which) else []:
            hit = group[x[which]] == g
            y = x[which[hit]]
            found.setdefault(int(g), []).append(np.stack([docs[y].astype(np.int64), starts[y] + where[hit], np.full(len(y), length)]))
    for g, parts in found.items():
        out.append((g, marks(*np.concatenate(parts, 1))))
    return table_of(out, MARKED)


def cut(table: pa.Table, marked: pa.Table) -> pa.Table:
    """Documents without their marked bytes."""
    if not table.num_rows:
        return table_of([], RESULT)
    ids = [NOBODY if x is None else x for x in table.column("doc_id").to_pylist()]
    rows = sorted(zip(ids, base.utf8(table.column("text")), strict=True))
    every = np.concatenate([np.zeros((3, 0), np.int64), *[np.frombuffer(x.as_py(), "<u4").reshape(3, -1).astype(np.int64) for x in marked.column("marks")]], 1)
    every = every[:, np.lexsort((every[1], every[0]))]
    at = np.searchsorted(every[0], np.arange(len(rows) + 1))
    out = []
    for i, (name, text) in enumerate(rows):
        start, size = every[1, at[i] : at[i + 1]], every[2, at[i] : at[i + 1]]
        pieces, removed, spans, last = [], 0, 0, 0
        if len(start):
            end = np.maximum.accumulate(start + size)
            new = np.flatnonzero(np.concatenate([[True], start[1:] > end[:-1]]))
            for a, b in zip(start[new].tolist(), end[np.concatenate([new[1:] - 1, [len(start) - 1]])].tolist(), strict=True):
                pieces.append(text[last:a])
                removed, spans, last = removed + b - a, spans + 1, b
        kept = hashlib.sha256(b"".join([*pieces, text[last:]])).hexdigest()
        out.append((None if name == NOBODY else name, len(text), removed, spans, kept))
    return table_of(out, RESULT)


def remove_repeats(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR, variants: int = VARIANTS) -> DataFrame:
    """docs: doc_id, text (null: empty). Returns a row for each: doc_id, n_bytes, n_removed, n_spans, kept_sha256.
    Documents are equal if their ids are, so rows that repeat an id don't mark each other; a null id comes after all
    others, and the largest possible id counts as null."""
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    total = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n = max(base.partitions(docs.sparkSession), -(-total // GROUP_BYTES))
    placed = texts.select(F.pmod(F.xxhash64("doc_id", "text"), F.lit(n)).cast("int").alias("g"), "doc_id", "text")
    sent = placed.groupBy("g").applyInArrow(lambda t: send(t, length, anchor, n), SENT)
    told = sent.groupBy("bucket").applyInArrow(lambda t: compare(t, variants), TOLD)
    shipped = placed.groupBy("g").cogroup(told.groupBy("g")).applyInArrow(lambda a, b: ship(a, b, length, anchor, n), SHIPPED)
    marked = shipped.groupBy("to").applyInArrow(lambda t: index_and_mark(t, length), MARKED)
    return placed.groupBy("g").cogroup(marked.groupBy("g")).applyInArrow(cut, RESULT)


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(base.table(spark, sf_dir, "documents"))
