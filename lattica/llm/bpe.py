"""Byte-pair encoding as a bounded-lookahead streaming transducer, and decoding.

A merge list has a sufficient lookahead: how far left of the end of what is read so far any later symbol can still
change the tokens. Tokens that end before that are stable and leave; their symbols are dropped, since merges never
cross a token border of the final result. So memory stays constant however long a word is. Words recur, so a table of
bounded size keeps the ids of short blank-free runs.

Work on rows is a map without shuffle; the vocabulary's path is a parameter and each worker reads the file once.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import json
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from lattica.llm import base

#: Fixed value: white space as Unicode defines it; str.split() would also cut at U+001C to U+001F.
BLANKS = "\t\n\x0b\x0c\r \x85\xa0  -     　"
BLANK_RUN = regex.compile(f"[{BLANKS}]+")
SEPARATORS = regex.compile("[\x1c-\x1f]")
SLICE = 1 << 20
#: Runs of up to so many characters are kept, and so many of them.
KEPT_CHARS, KEPT_RUNS = 48, 1 << 19
#: Ids that a decoder takes at once.
STEP = 1 << 16


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_alphabet() -> list[str]:
    """The printable stand-in of each byte: itself where printable in Latin-1, else the next free code point from
    256."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    free = iter(range(256, 512))
    return [chr(b if b in printable else next(free)) for b in range(256)]


class Runs(dict):
    """Blank-free run -> ids as little-endian unsigned 32-bit integers, filled on demand, bounded."""

    def __init__(self, encode):
        self.encode = encode

    def __missing__(self, run: str) -> bytes:
        ids = np.asarray(self.encode(run), "<u4").tobytes()
        if len(run) <= KEPT_CHARS:
            if len(self) >= KEPT_RUNS:
                self.clear()
            self[run] = ids
        return ids


class WordBpe:
    """The tokenizer of a tokenizers JSON file with NFC, blank folding and lower case, a split pattern, the byte
    alphabet and an end-of-word suffix."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab, suffix = model["vocab"], model["end_of_word_suffix"]
        self.added = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.names: list[str] = [""] * (1 + max([*vocab.values(), *self.added.values()]))
        for name, i in [*vocab.items(), *self.added.items()]:
            self.names[i] = name
        self.suffix = suffix
        self.pattern = regex.compile(next(x for x in spec["pre_tokenizer"]["pretokenizers"] if x["type"] == "Split")["pattern"]["Regex"])
        alphabet = byte_alphabet()
        self.inner, self.last = [vocab[c] for c in alphabet], [vocab[c + suffix] for c in alphabet]
        self.bytes_of = {c: b for b, c in enumerate(alphabet)}
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, (a, b) in enumerate(model["merges"]):
            self.merges.setdefault((vocab[a], vocab[b]), (rank, vocab[a + b]))
        # What each token adds to the text: its bytes, and a blank at the end of a word.
        self.pieces = [bytes(self.bytes_of[c] for c in x.removesuffix(suffix)) + b" " * x.endswith(suffix) if x not in self.added else x.encode() for x in self.names]
        self.lookahead = self.sufficient_lookahead()
        self.special = regex.compile("|".join(map(regex.escape, self.added))) if self.added else None
        self.runs = Runs(lambda run: [i for word in self.words(run) for i in self.stream(word)])

    def sufficient_lookahead(self) -> int | None:
        """Bytes before the end of what is read that later input may still change, or None if the list isn't proper
        (a merge uses a token that is only made later). A change spreads left only through a merge of a token u with
        the token after it, and then on through a later merge whose right part begins with u; so it reaches no
        further than the longest such chain of merges of rising rank, in bytes of their left parts."""
        made, left_of, size = {*self.inner, *self.last}, {}, {}
        size.update(dict.fromkeys(made, 1))
        reach: dict[int, int] = {}
        most = 0
        for (a, b), (_, t) in sorted(self.merges.items(), key=lambda x: x[1][0]):
            if a not in made or b not in made:
                return None
            made.add(t)
            left_of.setdefault(t, a)
            size.setdefault(t, size[a] + size[b])
            spine, best = b, 0
            while spine is not None:
                best, spine = max(best, reach.get(spine, 0)), left_of.get(spine)
            reach[a] = max(reach.get(a, 0), size[a] + best)
            most = max(most, reach[a])
        return most + 1

    def merged(self, symbols: list[int]) -> list[int]:
        """Merges by rank, the leftmost first among equal ranks."""
        n, merges = len(symbols), self.merges
        if n == 1:
            return symbols
        symbols, after, before = list(symbols), list(range(1, n + 1)), list(range(-1, n - 1))
        queue = [(*m, i, symbols[i], symbols[i + 1]) for i in range(n - 1) if (m := merges.get((symbols[i], symbols[i + 1])))]
        queue = [(r, i, t, a, b) for r, t, i, a, b in queue]
        heapq.heapify(queue)
        while queue:
            _, i, t, a, b = heapq.heappop(queue)
            j = after[i]
            if symbols[i] != a or j >= n or symbols[j] != b:
                continue
            symbols[i], symbols[j] = t, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if m := merges.get((t, symbols[k])):
                    heapq.heappush(queue, (m[0], i, m[1], t, symbols[k]))
            if (h := before[i]) >= 0 and (m := merges.get((symbols[h], t))):
                heapq.heappush(queue, (m[0], h, m[1], symbols[h], t))
        return [x for x in symbols if x >= 0]

    def stream(self, word: Iterable[int]) -> Iterator[int]:
        """Ids of a word's bytes, emitted once stable; holds at most a few lookaheads of symbols."""
        keep = self.lookahead
        held: list[int] = []
        latest = None
        sizes = self.sizes
        for b in word:
            if latest is not None:
                held.append(self.inner[latest])
            latest = b
            if keep is not None and len(held) >= 4 * keep + 64:
                at = 0
                for t in self.merged(held):
                    if at + sizes(t) > len(held) - keep:
                        break
                    at += sizes(t)
                    yield t
                del held[:at]
        if latest is not None:
            held.append(self.last[latest])
            yield from self.merged(held)

    def sizes(self, token: int) -> int:
        return len(self.names[token].removesuffix(self.suffix))

    @staticmethod
    def normal(text: str) -> str:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # no final sigma
        return text.lower()

    def words(self, run: str) -> Iterator[bytes]:
        for word in self.pattern.findall(run):
            yield word.encode()

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers. Special tokens' strings in the raw text are those tokens, as
        the library has it."""
        if self.special and (found := self.special.search(text)):
            out, at = [], 0
            while found:
                out += [self.encode_plain(text[at : found.start()]), np.asarray([self.added[found[0]]], "<u4").tobytes()]
                at = found.end()
                found = self.special.search(text, at)
            return b"".join([*out, self.encode_plain(text[at:])])
        return self.encode_plain(text)

    def encode_plain(self, text: str) -> bytes:
        return b"".join(b"".join(map(self.runs.__getitem__, split_runs(self.normal(part)))) for part in slices(text))

    def decode(self, ids: bytes) -> str:
        return "".join(self.decoded(ids, NamesDecoder(self)))

    def decode_text(self, ids: bytes) -> str:
        return "".join(self.decoded(ids, TextDecoder(self)))

    @staticmethod
    def decoded(ids: bytes, decoder: NamesDecoder | TextDecoder) -> Iterator[str]:
        """What the decoder gives for the ids, STEP of them at a time."""
        every = np.frombuffer(ids, "<u4")
        for i in range(0, len(every), STEP):
            yield decoder.feed(every[i : i + STEP].tolist())
        yield decoder.end()


class TextDecoder:
    """Incremental byte-to-text machine: tokens' bytes enter a UTF-8 machine, which holds no more than an unfinished
    character; the end of a word gives a blank, a special token its name. Malformed bytes give U+FFFD."""

    def __init__(self, bpe: WordBpe):
        self.pieces, self.machine = bpe.pieces, codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: list[int]) -> str:
        return self.machine.decode(b"".join([self.pieces[i] for i in ids]))

    def end(self) -> str:
        return self.machine.decode(b"", True)


class NamesDecoder:
    """The same with the library's form of a file without decoder: names of tokens, parted by blanks. Its state is
    whether a token has been seen."""

    def __init__(self, bpe: WordBpe):
        self.names, self.seen = bpe.names, False

    def feed(self, ids: list[int]) -> str:
        text = " ".join([self.names[i] for i in ids])
        out = " " + text if self.seen and ids else text
        self.seen = self.seen or bool(ids)
        return out

    def end(self) -> str:
        return ""


def slices(text: str, size: int = SLICE) -> Iterator[str]:
    """Parts of a long text, cut at white space."""
    at = 0
    while len(text) - at > size:
        found = BLANK_RUN.search(text, at + size)
        if not found:
            break
        yield text[at : found.start()]
        at = found.end()
    yield text[at:]


def split_runs(text: str) -> list[str]:
    if SEPARATORS.search(text):
        return [x for x in BLANK_RUN.split(text) if x]
    return text.split()


@lru_cache(2)
def loaded(path: str) -> WordBpe:
    return WordBpe(path)


def encode_documents(docs: DataFrame, path: str, with_ids: bool = False) -> DataFrame:
    """docs: doc_id, text. Returns doc_id, n_tokens, ids_sha256, decoded_sha256 (of the library's form of decoded text),
    text_sha256 (of the text that the ids stand for: normal form, words parted by blanks) and, if asked for, ids
    (binary). Both decoders feed their digest piece by piece. A null text is empty and has no tokens; repeated rows and
    null ids each give a row."""

    def digest(pieces: Iterator[str]) -> str:
        h = hashlib.sha256()
        for x in pieces:
            h.update(x.encode())
        return h.hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path)
        for batch in batches:
            n, a, b, c, kept = [], [], [], [], []
            for text in batch.column(1).to_pylist():
                ids = bpe.encode(text or "")
                n.append(len(ids) // 4)
                a.append(hashlib.sha256(ids).hexdigest())
                b.append(digest(bpe.decoded(ids, NamesDecoder(bpe))))
                c.append(digest(bpe.decoded(ids, TextDecoder(bpe))))
                if with_ids:
                    kept.append(ids)
            strings = [pa.array(x, pa.string()) for x in (a, b, c)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), *strings, *([pa.array(kept, pa.binary())] if with_ids else [])], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "text_sha256", *["ids"] * with_ids])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, text_sha256 string" + ", ids binary" * with_ids)


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(base.table(spark, sf_dir, "documents"), default_path())
