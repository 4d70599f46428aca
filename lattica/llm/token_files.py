"""Token-id files compressed by Re-Pair, with random access.

Documents are range-partitioned by id (only text moves, once) and sorted; each task encodes its documents and cuts
them into shards of bounded size. In a shard, frequent pairs of ids are replaced by nonterminals, round after round
until no pair is frequent: each round takes the most frequent pairs at once, replaces their occurrences from left to
right and adds one rule each. A shard stores the rules, the lengths of their expansions and the remaining sequence, so that any stretch of ids
is found by the sums of lengths and only rules that touch it are expanded. Shards are rows of a Parquet table.
"""

from __future__ import annotations

import hashlib
import os
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lattica.llm import base, bpe

END_ID = 2
SHARD_TOKENS = 1 << 20
#: Rules that a round adds at most, and occurrences of a pair that make it frequent.
RULES_A_ROUND, LEAST = 4000, 4
TABLE_BITS = 20
#: Units that the library encodes as one text; units that are kept, and four times as many ids.
PART, KEPT = 512, 1 << 20
#: A unit's key: so many 64-bit words, of its bytes (padded) and its length.
WORDS = 3
SHORT = 8 * WORDS - 1
SHARDS = "part int, seq int, vocabulary int, n_tokens long, doc_ids binary, doc_known binary, doc_tokens binary, rule_left binary, rule_right binary, rule_length binary, n_symbols int, sequence binary"
INDEX = "doc_id long, part int, seq int, begin long, n_tokens long, ids_crc32 long"

#: Kinds of bytes: blank, letter, digit, mark; odd ones are apostrophes (which join), controls and all that isn't ASCII.
BLANK, LETTER, DIGIT, MARK, ODD = range(5)


def kinds_of_bytes() -> np.ndarray:
    out = np.full(256, ODD, np.uint8)
    for c in map(chr, range(33, 127)):
        out[ord(c)] = LETTER if c.isalpha() else DIGIT if c.isdigit() else ODD if c == "'" else MARK
    out[list(b"\t\n\x0b\x0c\r ")] = BLANK
    return out


KIND = kinds_of_bytes()
LOWER = np.frombuffer(bytes(range(256)).lower(), np.uint8)
#: [word, length]: the bits of the key's word that a unit of that length fills.
MASKS = np.array([[(1 << 8 * min(max(n - 8 * j, 0), 8)) - 1 for n in range(SHORT + 1)] for j in range(WORDS)], np.uint64)


class LibraryUnits:
    """The tokenizers library on units of text, which recur. A unit ends at blanks, between an ASCII letter, digit or
    mark and one of another of these kinds, and behind each digit: the vocabulary's pattern cuts there in any
    context, so the ids of a text are those of its units. The library sees every new unit; a table of bounded size
    keeps their ids, by the unit's bytes, or by their hash where they are more than SHORT. It is kept in arrays, so
    that a batch of text is looked up at once."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks use the cores
        self.library, self.words = Tokenizer.from_file(path), Tokenizer.from_file(path)
        for x in (self.library, self.words):
            x.no_truncation()
            x.no_padding()
        # Units of ASCII letters, digits or marks are normal and one word each, so only the model is left to do.
        self.words.normalizer = normalizers.Sequence([])
        self.words.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.specials = [x.content.encode() for x in self.library.get_added_tokens_decoder().values()]
        names = self.library.get_vocab(with_added_tokens=True)
        self.vocabulary = 1 + max(names.values())
        self.ends = np.zeros(self.vocabulary, bool)  # tokens that end a word
        self.ends[[i for x, i in names.items() if x.endswith("</w>")]] = True
        self.clear()

    def clear(self) -> None:
        self.n = self.used = 0
        self.slots, self.keys = np.full(1 << 17, -1, np.int32), np.zeros((1 << 16, WORDS), np.uint64)
        self.begin, self.size, self.pool = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64), np.zeros(1 << 18, np.uint32)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Each key's entry, -1 where it has none."""
        mask = len(self.slots) - 1
        slot = (base.mix(keys[:, 0] ^ base.mix(keys[:, 1] ^ base.mix(keys[:, 2]))) & np.uint64(mask)).astype(np.int64)
        out = self.slots[slot]
        todo = np.flatnonzero((out >= 0) & (self.keys[out] != keys).any(1))
        while len(todo):
            slot[todo] = (slot[todo] + 1) & mask
            out[todo] = some = self.slots[slot[todo]]
            todo = todo[(some >= 0) & (self.keys[some] != keys[todo]).any(1)]
        return out

    def place(self, first: int) -> None:
        """Gives entries from first on a slot each."""
        mask = len(self.slots) - 1
        entry, keys = np.arange(first, self.n, dtype=np.int32), self.keys[first : self.n]
        slot = (base.mix(keys[:, 0] ^ base.mix(keys[:, 1] ^ base.mix(keys[:, 2]))) & np.uint64(mask)).astype(np.int64)
        while len(entry):
            free = self.slots[slot] < 0
            self.slots[slot[free]] = entry[free]
            lost = self.slots[slot] != entry
            entry, slot = entry[lost], (slot[lost] + 1) & mask

    def add(self, keys: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> None:
        n, used = self.n + len(keys), self.used + len(ids)
        grown = len(self.keys)
        while grown < n:
            grown *= 2
        if grown > len(self.keys):
            self.keys, self.begin, self.size = (np.concatenate([x, np.zeros((grown - len(x), *x.shape[1:]), x.dtype)]) for x in (self.keys, self.begin, self.size))
        if used > len(self.pool):
            self.pool = np.concatenate([self.pool[: self.used], np.zeros(used, np.uint32)])
        self.keys[self.n : n], self.size[self.n : n] = keys, sizes
        self.begin[self.n : n] = self.used + np.cumsum(sizes) - sizes
        self.pool[self.used : used] = ids
        first, self.n, self.used = self.n, n, used
        if 2 * grown > len(self.slots):
            self.slots, first = np.full(2 * grown, -1, np.int32), 0
        self.place(first)

    def learned(self, units: list[bytes], plain: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all units end to end, how many each has). Plain units, and others of letters only, are one word each,
        so they go to the library together and are told apart by the tokens that end a word."""
        out: list = [np.zeros(0, np.uint32)] * len(units)
        text = [x.decode() for x in units]
        own = np.flatnonzero(plain)
        spelt = np.array([i for i in np.flatnonzero(~plain).tolist() if text[i].isalpha()], np.int64)
        alone = set(np.flatnonzero(~plain).tolist()) - set(spelt.tolist())
        for library, which in ((self.words, own), (self.library, spelt)):
            parts = [which[i : i + PART].tolist() for i in range(0, len(which), PART)]
            for part, x in zip(parts, library.encode_batch_fast([" ".join([text[i] for i in p]) for p in parts], add_special_tokens=False), strict=True):
                ids = np.asarray(x.ids, np.uint32)
                ends = np.flatnonzero(self.ends[ids]) + 1
                if len(ends) == len(part):
                    at, bounds = 0, ends.tolist()
                    for i, end in zip(part, bounds, strict=True):
                        out[i], at = ids[at:end], end
                else:  # letters to Python that are none to the library
                    alone.update(part)
        rest = sorted(alone)
        for i, x in zip(rest, self.library.encode_batch_fast([text[i] for i in rest], add_special_tokens=False), strict=True):
            out[i] = np.asarray(x.ids, np.uint32)
        return np.concatenate(out), np.array([len(x) for x in out], np.int64)

    def encode(self, text: str) -> bytes:
        return self.encode_all([text.encode()])[0].astype("<u4").tobytes()

    def encode_all(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts end to end, how many each has)."""
        if whole := [i for i, x in enumerate(texts) if any(s in x for s in self.specials)]:
            ids, many = self.encode_all([b"" if i in whole else x for i, x in enumerate(texts)])
            parts = np.split(ids, np.cumsum(many)[:-1])
            for i in whole:
                parts[i] = np.asarray(self.library.encode(texts[i].decode(), add_special_tokens=False).ids, np.uint32)
            return np.concatenate(parts), np.array([len(x) for x in parts], np.int64)
        if self.n > KEPT or self.used > 4 * KEPT:
            self.clear()
        raw = np.frombuffer(b"\n".join([b"", *texts, bytes(8 * WORDS)]), np.uint8)
        n = len(raw) - 8 * WORDS
        low = LOWER[raw]
        odd = np.flatnonzero(raw[1:] >= 128)
        low[odd] = raw[odd]  # a letter may be the base of a combining mark
        kind = KIND[raw[:n]]
        a, b = kind[:-1], kind[1:]
        new = (b > 0) & ((a != b) & ((a == 0) | (a < ODD) & (b < ODD)) | (b == DIGIT) & (a == DIGIT))
        start = np.flatnonzero(new) + 1
        stop = np.flatnonzero((a > 0) & (new | (b == 0))) + 1
        size = stop - start
        window = np.ndarray(len(low) - 7, "<u8", low, 0, (1,))
        short = np.minimum(size, SHORT)
        keys = np.stack([window[start + 8 * j] & MASKS[j, short] for j in range(WORDS)], 1)
        keys[:, -1] |= size.clip(max=SHORT + 1).astype(np.uint64) << np.uint64(56)
        for i in np.flatnonzero(size > SHORT).tolist():
            keys[i] = np.frombuffer(hashlib.blake2b(low[start[i] : stop[i]], digest_size=8 * WORDS).digest(), "<u8")
            keys[i, -1] |= np.uint64(0xFF << 56)
        entry = self.find(keys)
        if len(miss := np.flatnonzero(entry < 0)):
            code = keys[miss]
            order = np.lexsort(code.T)
            first = np.concatenate([[True], (code[order][1:] != code[order][:-1]).any(1)])
            one = miss[order[first]]
            data, mixed = low.tobytes(), np.zeros(len(start), bool)
            mixed[np.searchsorted(start, np.flatnonzero(kind == ODD), "right") - 1] = True
            ids, many = self.learned([data[x:y] for x, y in zip(start[one].tolist(), stop[one].tolist(), strict=True)], ~mixed[one])
            at = self.n
            self.add(keys[one], ids, many)
            entry[miss[order]] = at + np.cumsum(first) - 1
        many = self.size[entry]
        before = np.cumsum(many) - many
        index = np.repeat(self.begin[entry] - before, many)
        index += np.arange(len(index))
        ids = self.pool[index]
        edges = 1 + np.cumsum([0, *(len(x) + 1 for x in texts)])
        return ids, np.diff(np.concatenate([before, [len(ids)]])[np.searchsorted(start, edges)])


@lru_cache(2)
def library(path: str) -> LibraryUnits:
    return LibraryUnits(path)


def apart(touch: np.ndarray) -> np.ndarray:
    """Which ascending places stay so that no two of them touch: every second of a run of places that each touch the one
    before, from its left."""
    i = np.arange(len(touch))
    return (i - np.maximum.accumulate(np.where(touch, 0, i))) % 2 == 0


def compress(ids: np.ndarray, vocabulary: int, rules_a_round: int = RULES_A_ROUND, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sequence, left, right): rule i, the nonterminal vocabulary + i, stands for left[i] right[i]. No pair occurs
    least times in the sequence without overlaps. Symbols are linked, so that a round costs what the pairs do that were
    frequent or have a new symbol."""
    n, rules = len(ids), 0
    lefts, rights = [np.zeros(0, np.uint32)], [np.zeros(0, np.uint32)]
    s, gone, live = np.concatenate([ids.astype(np.uint32), [np.uint32(0)]]), np.zeros(n + 1, bool), np.zeros(n + 1, bool)
    after, before = np.arange(1, n + 2, dtype=np.int32), np.arange(-1, n, dtype=np.int32)
    at = np.arange(max(n - 1, 0), dtype=np.int32)  # the left places of these pairs
    while True:
        pair = s[at].astype(np.uint64) << np.uint64(32) | s[after[at]]
        if len(at) > 1 << TABLE_BITS - 3:  # a pair of a slot with fewer is not frequent
            slot = ((pair * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - TABLE_BITS)).astype(np.int32)
            some = np.bincount(slot, minlength=1 << TABLE_BITS)[slot] >= least
            at, pair = at[some], pair[some]
        code, pairs = pd.factorize(pair)
        touch = np.zeros(len(at), bool)
        touch[1:] = after[at[:-1]] == at[1:]
        own = apart(touch & (np.diff(code, prepend=-1) == 0))
        counts = np.bincount(code[own], minlength=len(pairs))
        frequent = counts >= least
        many = min(rules_a_round, int(frequent.sum()))
        if not many:
            break
        while True:
            chosen = np.zeros(len(pairs), bool)
            chosen[np.argpartition(counts, len(pairs) - many)[len(pairs) - many :]] = True
            use = np.flatnonzero(own & chosen[code])
            touch = np.zeros(len(use), bool)
            touch[1:] = after[at[use[:-1]]] == at[use[1:]]
            use = use[apart(touch)]
            chosen &= np.bincount(code[use], minlength=len(pairs)) >= least
            if chosen.any():
                break
            many = max(many // 8, 1)  # pairs that overlap took each other's places; one alone keeps its own
        use, good = use[chosen[code[use]]], np.flatnonzero(chosen)
        name = np.zeros(len(pairs), np.uint32)
        name[good] = vocabulary + rules + np.arange(len(good), dtype=np.uint32)
        lefts.append((pairs[good] >> np.uint64(32)).astype(np.uint32))
        rights.append((pairs[good] & np.uint64(0xFFFFFFFF)).astype(np.uint32))
        rules += len(good)
        first = at[use]
        second = after[first]
        third = after[second]
        s[first], after[first], before[third], gone[second] = name[code[use]], third, first, True
        live[at[frequent[code]]] = live[first] = live[np.maximum(before[first], 0)] = True
        at = np.flatnonzero(live).astype(np.int32)
        live[at] = False
        at = at[~gone[at] & (after[at] < n)]
    return s[:n][~gone[:n]], np.concatenate(lefts), np.concatenate(rights)


def packed(x: np.ndarray, bits: int) -> bytes:
    """The low 16 bits of all numbers, then each higher bit of all."""
    return b"".join([x.astype("<u2").tobytes(), *(np.packbits((x >> np.uint32(k) & np.uint32(1)).astype(bool)).tobytes() for k in range(16, bits))])


def unpacked(raw: bytes, n: int, bits: int) -> np.ndarray:
    out, size = np.frombuffer(raw, "<u2", n).astype(np.uint32), (n + 7) // 8
    for k in range(16, bits):
        out |= np.unpackbits(np.frombuffer(raw, np.uint8, size, 2 * n + (k - 16) * size), count=n).astype(np.uint32) << np.uint32(k)
    return out


def levels(left: np.ndarray, right: np.ndarray, vocabulary: int) -> Iterator[slice]:
    """Consecutive rules of which none uses another."""
    a, newest = 0, np.maximum(left, right).astype(np.int64) - vocabulary
    while a < len(left):
        b = min(len(left), a + RULES_A_ROUND)
        users = np.flatnonzero(newest[a:b] >= a)
        b = a + int(users[0]) if len(users) else b
        yield slice(a, b)
        a = b


def lengths(left: np.ndarray, right: np.ndarray, vocabulary: int) -> np.ndarray:
    out = np.ones(len(left) + 1, np.int64)  # the last stands for an id
    for x in levels(left, right, vocabulary):
        out[x] = sum(out[np.where(p[x] >= vocabulary, p[x].astype(np.int64) - vocabulary, -1)] for p in (left, right))
    return out[:-1]


def expansions(left: np.ndarray, right: np.ndarray, size: np.ndarray, vocabulary: int) -> tuple[np.ndarray, np.ndarray]:
    """All rules' ids end to end, and where each begins."""
    at = np.concatenate([[0], np.cumsum(size)])
    flat = np.zeros(int(at[-1]), np.uint32)
    for x in levels(left, right, vocabulary):
        to = at[:-1][x]
        for part in (left[x], right[x]):
            plain = part < vocabulary
            flat[to[plain]] = part[plain]
            k = part[~plain].astype(np.int64) - vocabulary
            many = size[k]
            step = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            flat[np.repeat(to[~plain], many) + step] = flat[np.repeat(at[k], many) + step]
            to = to + 1
            to[~plain] += many - 1
    return flat, at


class Shard:
    """A stored shard: documents' ids by random access, or all of them."""

    def __init__(self, row):
        self.vocabulary = int(row.vocabulary)
        self.size = np.frombuffer(row.rule_length, "<u4")
        bits = (self.vocabulary + len(self.size)).bit_length()
        self.left, self.right = (unpacked(x, len(self.size), bits) for x in (row.rule_left, row.rule_right))
        self.sequence = unpacked(row.sequence, row.n_symbols, bits).astype(np.int64)
        self.doc_ids, self.known = np.frombuffer(row.doc_ids, "<i8"), np.frombuffer(row.doc_known, bool)
        self.tokens = np.frombuffer(row.doc_tokens, "<u4").astype(np.int64)
        self.begins = np.concatenate([[0], np.cumsum(self.tokens)])
        self.flat, self.at = expansions(self.left, self.right, self.size.astype(np.int64), self.vocabulary)
        rule = np.maximum(self.sequence - self.vocabulary, 0)
        self.each = np.where(self.sequence < self.vocabulary, 1, self.size[rule] if len(self.size) else 1).astype(np.int64)
        self.ends = np.cumsum(self.each)

    def ids(self, begin: int, end: int) -> np.ndarray:
        """ids[begin:end] of the shard; only symbols that touch them are expanded."""
        if end <= begin:
            return np.zeros(0, np.uint32)
        a, b = np.searchsorted(self.ends, begin, "right"), np.searchsorted(self.ends, end, "left") + 1
        symbols, each = self.sequence[a:b], self.each[a:b]
        rules = symbols >= self.vocabulary
        shift = np.concatenate([[0], np.cumsum(each)[:-1]])
        where = np.where(rules, self.at[np.maximum(symbols - self.vocabulary, 0)], 0) - shift
        index = np.repeat(where, each)
        index += np.arange(len(index))
        out = np.repeat(symbols, each).astype(np.uint32)
        inside = np.repeat(rules, each)
        if len(self.flat):
            out[inside] = self.flat[index[inside]]
        skip = begin - (self.ends[a] - self.each[a])
        return out[skip : skip + end - begin]

    def document(self, i: int) -> np.ndarray:
        return self.ids(int(self.begins[i]), int(self.begins[i + 1]))


def shard_row(part: int, seq: int, docs: list, ids: list[bytes], vocabulary: int) -> dict:
    every = np.frombuffer(b"".join(ids), "<u4")
    s, left, right = compress(every, vocabulary)
    size = lengths(left, right, vocabulary)
    bits = (vocabulary + len(left)).bit_length()
    return {
        "part": part, "seq": seq, "vocabulary": vocabulary, "n_tokens": len(every), "doc_ids": np.asarray([x or 0 for x in docs], "<i8").tobytes(), "doc_known": np.asarray([x is not None for x in docs], bool).tobytes(),
        "doc_tokens": np.asarray([len(x) // 4 for x in ids], "<u4").tobytes(), "rule_left": packed(left, bits), "rule_right": packed(right, bits), "rule_length": size.astype("<u4").tobytes(),
        "n_symbols": len(s), "sequence": packed(s, bits),
    }


def write(docs: DataFrame, path: str, vocabulary_path: str, end_id: int = END_ID, shard_tokens: int = SHARD_TOKENS) -> None:
    """docs: doc_id, text (null: empty). Documents come in ascending id order, null ids first, then by text; a document
    never spans shards, so one longer than shard_tokens has a shard of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = library(vocabulary_path), np.asarray([end_id], "<u4").tobytes()
        part, seq, ids, names, held = TaskContext.get().partitionId(), 0, [], [], 0
        schema = None

        def out():
            frame = pd.DataFrame([shard_row(part, seq, names, ids, max(encoder.vocabulary, end_id + 1))])
            return pa.RecordBatch.from_pandas(frame.astype({"part": "int32", "seq": "int32", "vocabulary": "int32", "n_symbols": "int32"}), schema, preserve_index=False)

        for batch in batches:
            texts, every = base.utf8(batch.column(1)), batch.column(0).to_pylist()
            for a, b in base.chunks(texts):
                flat, many = encoder.encode_all(texts[a:b])
                raw, at = memoryview(flat.astype("<u4").tobytes()), np.concatenate([[0], 4 * np.cumsum(many)]).tolist()
                for name, x, y in zip(every[a:b], at[:-1], at[1:], strict=True):
                    ids.append(b"".join([raw[x:y], end]))
                    names.append(name)
                    held += len(ids[-1]) // 4
                    if held >= shard_tokens:
                        yield out()
                        seq, ids, names, held = seq + 1, [], [], 0
        if ids:
            yield out()

    ordered = docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(run, SHARDS).write.parquet(path)


def index(shards: DataFrame) -> DataFrame:
    """Reads shards back: per document its place in the shard, its tokens and their checksum."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples():
                shard = Shard(row)
                every = shard.ids(0, int(shard.begins[-1])).astype("<u4").tobytes()
                crc = [zlib.crc32(memoryview(every)[4 * a : 4 * b]) for a, b in zip(shard.begins[:-1].tolist(), shard.begins[1:].tolist(), strict=True)]
                ids = pd.array(shard.doc_ids, "Int64")
                ids[~shard.known] = pd.NA
                yield pd.DataFrame({"doc_id": ids, "part": row.part, "seq": row.seq, "begin": shard.begins[:-1], "n_tokens": shard.tokens, "ids_crc32": crc})

    return shards.mapInPandas(run, INDEX)


def starts(shards: DataFrame) -> DataFrame:
    """Ids before each shard. One row a shard, of which there are as many as files of ids would be; sums within a
    task's shards come first, so that only a row for each task is ordered as a whole."""
    within = shards.select("part", "seq", "n_tokens").withColumn("before", F.sum("n_tokens").over(Window.partitionBy("part").orderBy("seq")) - F.col("n_tokens"))
    parts = within.groupBy("part").agg(F.sum("n_tokens").alias("n")).withColumn("base", F.sum("n").over(Window.orderBy("part")) - F.col("n"))
    return within.join(parts, "part").select("part", "seq", (F.col("before") + F.col("base")).alias("shard_start"))


def read(spark: SparkSession, path: str) -> DataFrame:
    shards = spark.read.parquet(path)
    return index(shards).join(starts(shards), ["part", "seq"]).select("doc_id", (F.col("shard_start") + F.col("begin")).alias("start"), "n_tokens", "ids_crc32")


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = base.scratch(spark) + "/tokens"
    write(base.table(spark, sf_dir, "documents"), path, bpe.default_path())
    return read(spark, path)
