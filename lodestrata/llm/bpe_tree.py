"""Byte-level BPE encoding and decoding by monoid tree reduction.

An encoded stretch of bytes is an element of a monoid: two neighbours are joined without looking
at all their bytes again. The join re-encodes a window of the last tokens of the left and the
first tokens of the right. If the window's outermost tokens come out unchanged (or the window
ends where a side ends), everything outside of it is proven to stay; else the window grows on the side that moved.

Why that is a proof: merging always takes the lowest rank, leftmost first. A sequence of tokens is
the encoding of its bytes exactly if each pair of neighbours is the encoding of its own bytes: the
first merge over a border would have been the first one in the pair's own run too. Pairs inside a
side are good because the side is an encoding, pairs inside the window because the window is one, and
an unchanged outermost token makes the pair over the window's edge one of the side's own.

The tree has two levels, as the vocabulary has:

* A piece (a match of the pattern) is halved down to ``LEAF_BYTES`` and joined as above. What short
  halves give is remembered, within a bound. A piece that is a token as a whole is that token.
* A text is halved down to ``LEAF`` characters; a leaf is cut into pieces by the pattern. At a
  join the last pieces of the left that lie within ``LOOK`` characters of its end are open (the pattern looks no
  further ahead), and a growing window of the right's pieces is matched again with them, until a
  border of the new matches falls on one of the right's: a match depends only on what
  follows its start, so the pieces behind are the same ones.

Decoding concatenates the bytes of halves up the same kind of tree. Everything happens in the row, so
nothing is shuffled, and documents of a hot source are spread like any others.

Character classes are those of the encoder library, asked from it once per worker: its tables
are of another Unicode version than those of the ``regex`` module.

Defined cases: a null text is an empty one; an empty text has no ids; there are no special
tokens, their strings are ordinary text; repeated rows are encoded each; an empty table gives an
empty result; a null doc_id is carried as null; other columns are ignored by the query and kept by
``encode_texts``, whose new columns must have names of their own.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterable, Iterator
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, StructField, StructType

from lodestrata.llm.common import table

#: Characters of a leaf of the text tree and ids of a leaf of the decoding tree.
LEAF = 4096
#: A match is fixed once this many characters follow it: ``'ll`` is the longest look ahead of the pattern.
LOOK = 2
#: Bytes of a leaf of a piece's tree.
LEAF_BYTES = 6
#: Entries of each half of each of a worker's four memories; the longest bytes remembered of halves and windows.
MEMORY = 300_000
SHORT = 64
#: Ids put into one Arrow batch before it is handed on (a single longer text is a batch by itself).
BATCH_IDS = 1 << 20


def default_ranks() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def default_pattern() -> str:
    import public_tokenizers
    return public_tokenizers.PATTERN


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(bytes.strip, lines))}


class Matcher:
    """``findall`` of a pattern with the encoder library's own letters, digits and blanks."""

    def __init__(self, pattern: str):
        self.pattern, self.plain, self.odd = pattern, regex.compile(pattern), None

    def ask(self) -> None:
        """Compare the classes; only texts with a character on which the two differ need the long form."""
        every = "".join(map(chr, chain(range(0xD800), range(0xE000, 0x110000))))
        odd, exact = set(), self.pattern
        for name in (r"\p{L}", r"\p{N}", r"\s"):
            theirs, ours = self.members(name, every), set(regex.findall(name, every))
            odd |= theirs ^ ours
            exact = self.put(exact, name, theirs)
        self.odd, self.exact = regex.compile(f"[{self.ranges(odd)}]" if odd else r"(?!)"), regex.compile(exact)

    @staticmethod
    def members(name: str, every: str) -> set[str]:
        import tiktoken
        one = tiktoken.Encoding(name, pat_str=name, mergeable_ranks={bytes([b]): b for b in range(256)}, special_tokens={})
        return set(one.decode(one.encode_ordinary(every)))

    @staticmethod
    def ranges(members: set[str]) -> str:
        points, out = sorted(map(ord, members)), []
        for p in points:
            if out and out[-1][1] == p - 1:
                out[-1][1] = p
            else:
                out.append([p, p])
        return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in out)

    @classmethod
    def put(cls, pattern: str, name: str, members: set[str]) -> str:
        """The pattern with the class spelt out, within brackets and outside; ``\\S`` follows ``\\s``."""
        body, out, inside = cls.ranges(members), [], False
        at = 0
        while at < len(pattern):
            if pattern.startswith(name, at):
                out.append(body if inside else f"[{body}]")
                at += len(name)
            elif name == r"\s" and pattern.startswith(r"\S", at) and not inside:
                out.append(f"[^{body}]")
                at += 2
            else:
                step = 2 if pattern[at] == "\\" else 1
                inside = {"[": True, "]": False}.get(pattern[at], inside)
                out.append(pattern[at:at + step])
                at += step
        return "".join(out)

    def __call__(self, text: str) -> list[str]:
        if not text.isascii():
            try:
                text.encode("latin-1")  # all versions agree on these characters
            except UnicodeEncodeError:
                if self.odd is None:
                    self.ask()
                if self.odd.search(text):
                    return self.exact.findall(text)
        return self.plain.findall(text)


class Memory(dict):
    """A bounded memory of a function of the key; ``keep`` says which keys stay.

    When it is full it becomes the old half, and what is asked for again comes back from there, so
    frequent keys stay.
    """

    def __init__(self, make, keep=lambda key: True):
        self.make, self.keep, self.old = make, keep, {}

    def __missing__(self, key):
        found = self.old.get(key)
        if found is None:
            found = self.make(key)
            if not self.keep(key):
                return found
        if len(self) >= MEMORY:
            self.old = dict(self)
            self.clear()
        self[key] = found
        return found


class TreeEncoder:
    """Ids of texts by ranks; joins of encoded halves."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, leaf: int = LEAF):
        self.ranks, self.leaf = ranks, leaf
        self.bytes = dict(zip(ranks.values(), ranks))
        self.match = Matcher(pattern)
        short = lambda key: len(key) <= SHORT
        self.windows, self.halves = Memory(self.merge, short), Memory(self.halve, short)
        self.pairs = Memory(lambda pair: self.merge(self.bytes[pair[0]] + self.bytes[pair[1]]))
        self.pieces = Memory(self.word, short)

    # Bytes of one piece.

    def merge(self, piece: bytes) -> tuple[int, ...]:
        """Encoding of a window from its bytes: lowest rank first, leftmost first."""
        rank, none, n = self.ranks.get, 1 << 60, len(piece)
        cut = list(range(n + 1))
        pairs = [rank(piece[at:at + 2], none) for at in range(n - 1)]
        while pairs and (least := min(pairs)) < none:
            at = pairs.index(least)
            del cut[at + 1], pairs[at]
            if at < len(pairs):
                pairs[at] = rank(piece[cut[at]:cut[at + 2]], none)
            if at:
                pairs[at - 1] = rank(piece[cut[at - 1]:cut[at + 1]], none)
        return tuple([self.ranks[piece[a:b]] for a, b in pairwise(cut)])

    def join(self, left: tuple[int, ...], right: tuple[int, ...]) -> tuple[int, ...]:
        """Encoding of two encoded neighbours, from windows around their border.

        Where the right's first token does not come out unchanged, the window's tokens go to the left, which
        is then an encoding of more bytes, and the border is one token further: rows of one character, which
        fall out of step for good, cost a step per token and never a window of all of them.
        """
        at, m = 0, len(right)
        while True:
            i, n = 1, len(left)
            window = self.pairs[left[-1], right[at]]
            while i < n and window[0] != left[n - i]:
                i = min(2 * i, n)
                window = self.windows[b"".join(map(self.bytes.__getitem__, (*left[n - i:], right[at])))]
            at += 1
            if at == m or window[-1] == right[at - 1]:
                return (*left[:n - i], *window, *right[at:])
            if isinstance(left, tuple):
                left = list(left)
            left[n - i:] = window

    def halve(self, piece: bytes) -> tuple[int, ...]:
        if len(piece) <= LEAF_BYTES:
            return self.merge(piece)
        middle = len(piece) // 2
        return self.join(self.halves[piece[:middle]], self.halves[piece[middle:]])

    def word(self, piece: str) -> bytes:
        """Ids of a piece, as the bytes of native ints: they take less room and are joined faster."""
        piece = piece.encode()
        rank = self.ranks.get(piece)
        return array("i", self.halve(piece) if rank is None else (rank,)).tobytes()

    # Pieces of one text.

    def tree(self, text: str) -> tuple[list[str], list[bytes]]:
        """The pieces of a text and the ids of each."""
        if len(text) <= max(self.leaf, 1):
            pieces = self.match(text)
            return pieces, list(map(self.pieces.__getitem__, pieces))
        middle = len(text) // 2
        return self.join_texts(self.tree(text[:middle]), self.tree(text[middle:]))

    def join_texts(self, left, right):
        pieces, ids = left
        follow, follow_ids = right
        open_tail = ""
        while pieces and len(open_tail) < LOOK:
            open_tail = pieces.pop() + open_tail
            ids.pop()
        k = 2
        while True:
            k = min(k, len(follow))
            borders, at = {len(open_tail): 0}, len(open_tail)
            for number, piece in enumerate(follow[:k], 1):
                at += len(piece)
                borders[at] = number
            window = open_tail + "".join(follow[:k])
            again, at = [], 0
            whole = k == len(follow)
            fixed = len(window) if whole else len(window) - LOOK
            for piece in self.match(window):
                if at in borders and at >= len(open_tail):
                    break
                at += len(piece)
                if at > fixed:
                    at = -1
                    break
                again.append(piece)
            if at in borders or whole:
                pieces += again
                ids += map(self.pieces.__getitem__, again)
                stay = borders.get(at, len(follow))
                pieces += follow[stay:]
                ids += follow_ids[stay:]
                return pieces, ids
            k *= 2

    def encode(self, text: str) -> array:
        return array("i", b"".join(self.tree(text)[1]))

    def decode(self, ids: list[int]) -> bytes:
        if len(ids) <= max(self.leaf, 1):
            return b"".join(map(self.bytes.__getitem__, ids))
        middle = len(ids) // 2
        return self.decode(ids[:middle]) + self.decode(ids[middle:])


_ENCODERS: dict[tuple[str, str], TreeEncoder] = {}


def tree_encoder(path: str, pattern: str) -> TreeEncoder:
    """One encoder per Python worker, kept between tasks."""
    if (path, pattern) not in _ENCODERS:
        _ENCODERS[path, pattern] = TreeEncoder(read_ranks(path), pattern)
    return _ENCODERS[path, pattern]


def _spans(sizes: Iterable[int]) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most ``BATCH_IDS`` in sum, or of one row."""
    start, total, end = 0, 0, 0
    for end, size in enumerate(sizes, 1):
        if total and total + size > BATCH_IDS:
            yield start, end - 1
            start, total = end - 1, 0
        total += size
    if start < end:
        yield start, end


def encode_texts(docs: DataFrame, text: str = "text", ids: str = "ids", ranks: str | None = None,
                 pattern: str | None = None) -> DataFrame:
    """``docs`` with the ids of ``text`` as array<int> in place of the text."""
    path, cut = ranks or default_ranks(), pattern or default_pattern()
    rest = [c for c in docs.columns if c != text]
    schema = StructType([*docs.select(*rest).schema.fields, StructField(ids, ArrayType(IntegerType(), False))])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tree_encoder(path, cut)
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text))
            keep = [batch.column(batch.schema.get_field_index(c)) for c in rest]
            # An upper bound of the ids of a text is its bytes; reading it costs nothing.
            lengths = pc.binary_length(texts).fill_null(0).to_pylist()
            for a, b in _spans(lengths):
                found = [encoder.encode(t.as_py() or "") for t in texts.slice(a, b - a)]
                flat = np.concatenate([np.frombuffer(f, np.int32) for f in found] or [np.empty(0, np.int32)])
                offsets = np.cumsum([0, *map(len, found)], dtype=np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, pa.int32()))
                yield pa.RecordBatch.from_arrays([*[c.slice(a, b - a) for c in keep], lists], names=[*rest, ids])

    return docs.select(*rest, text).mapInArrow(run, schema)


def decode_ids(encoded: DataFrame, ids: str = "ids", decoded: str = "decoded", ranks: str | None = None,
               pattern: str | None = None) -> DataFrame:
    """``encoded`` with the bytes of its ids; a null list is an empty one."""
    path, cut = ranks or default_ranks(), pattern or default_pattern()
    columns = encoded.columns
    schema = StructType([*encoded.schema.fields, StructField(decoded, BinaryType())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tree_encoder(path, cut)
        for batch in batches:
            lists = batch.column(batch.schema.get_field_index(ids))
            for a, b in _spans(pc.list_value_length(lists).fill_null(0).to_pylist()):
                part = batch.slice(a, b - a)
                made = [encoder.decode(t.as_py() or []) for t in lists.slice(a, b - a)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(made, pa.binary())], names=[*columns, decoded])

    return encoded.mapInArrow(run, schema)


def op12_bpe_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    both = decode_ids(encode_texts(docs))
    decimal = F.array_join(F.transform("ids", lambda i: i.cast("string")), " ")
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(decimal, 256).alias("ids_sha256"),
                       F.sha2("decoded", 256).alias("decoded_sha256"))
