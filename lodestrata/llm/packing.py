"""Packing documents into token windows with the sum-of-squares rule, online.

Every task streams its documents. A document is encoded, its whole windows are emitted at
once, and the rest is placed like an item of online bin packing: into the fill level h
that minimises the sum over the levels of the squared number of windows at that level
(moving a window from h to h + n changes the counts of two levels only, so the choice is
one vector expression over the level array). Level 0 stands for opening a new window.
Windows at level ``width`` are full and leave.

At the end of a task the open windows are closed: the lowest ones are cut to fill the
gaps of the highest, which leaves one window; it is cut into windows whose lengths are
powers of two, which need no padding.

Nothing is shuffled and a task's memory holds its open windows only. sequence_id is the
task's number times 2^33 plus a running number. It depends on how the files are split
into tasks, not on which executor runs a task or how often.

Encoding is word by word: a blank between two other characters always starts a new piece
of the byte-level vocabulary, so the ids of "blank + word" are looked up in a bounded
cache and only words not seen yet are encoded. The ids are those of the tokenizer file
read by ``tokenizers``; where its merge rules are in the order of its ids (tested when it
is loaded) the merging itself is left to ``tiktoken``, which gives the same ids faster. A
text that holds the string of an added token goes through ``tokenizers`` as a whole.

Defined cases: a null text is an empty one; an empty text is the single id 0; repeated
rows are packed each; an empty table gives an empty result; extra columns are ignored. A
null doc_id is carried as null.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from lodestrata.llm.common import table

WIDTH = 1024
END_ID = 0
#: Words whose ids a worker remembers; some 200 bytes each.
CACHE_WORDS = 800_000

SCHEMA = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, "
          "`offset` long, sequence_length long")
NAMES = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "sequence_length")


def default_tokenizer() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


#: Pieces of a byte-level vocabulary; the pattern built into the ``tokenizers`` pre-tokenizer.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def ranked_vocabulary(tokenizer) -> dict[bytes, int] | None:
    """Byte strings and ids of a byte-level BPE file whose merge order is its id order, else None.

    Where the i-th merge makes the token with the i-th id, merging by lowest id and merging
    by first rule are the same thing, and a rank-based encoder gives the file's ids.
    """
    import json
    model = json.loads(tokenizer.to_str())["model"]
    pairs = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
    ids = [model["vocab"].get(p, -1) for p in pairs]
    if ids != sorted(set(ids)) or ids[:1] == [-1]:
        return None
    # The byte-level alphabet: printable bytes stand for themselves, the others for code points from 256 on.
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(b): b for b in plain}
    byte.update({chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(plain)))})
    made = set(pairs) | set(byte)
    return {bytes(map(byte.__getitem__, t)): i for t, i in model["vocab"].items() if t in made}


class Words(dict):
    """Ids (uint32 bytes) of a blank and a word; a word that is not there yet is encoded and kept."""

    def __init__(self, encode, most: int):
        self.encode, self.most = encode, most

    def __missing__(self, word: str) -> bytes:
        if len(self) >= self.most:
            self.clear()
        ids = self[word] = self.encode(f" {word}")
        return ids


class Encoder:
    """Ids of whole texts as little-endian uint32 bytes; those of the tokenizer file on the whole text."""

    BLANKS = re.compile(r"\s\s|^ | $")

    def __init__(self, path: str, cache_words: int = CACHE_WORDS):
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(map(re.escape, added)) or r"(?!)")
        ranks = ranked_vocabulary(self.tokenizer)
        if ranks:
            import tiktoken
            self.ordinary = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks,
                                              special_tokens={}).encode_ordinary
        else:
            self.ordinary = lambda text: self.tokenizer.encode(text, add_special_tokens=False).ids
        self.words = Words(self.part, cache_words)

    def part(self, text: str) -> bytes:
        return array("I", self.ordinary(text)).tobytes()

    def encode(self, text: str) -> bytes:
        if self.added.search(text):  # an added token is one id, also where it stands in a text
            return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        # A blank between two other characters always starts a piece of the pattern.
        if self.BLANKS.search(text):
            first, *rest = re.split(r"(?<=\S) (?=\S)", text)
        else:
            first, *rest = text.split(" ")
        return self.part(first) + b"".join(map(self.words.__getitem__, rest))


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder per Python worker, kept between tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


class Packer:
    """Online sum-of-squares packing; ``put`` and ``close`` yield finished pieces."""

    def __init__(self, width: int = WIDTH, first_id: int = 0):
        self.width, self.next_id = width, first_id
        self.levels = np.zeros(width + 1, np.int64)  # open windows by fill level; 0 and width stay 0
        self.open: list[list[list]] = [[] for _ in range(width + 1)]  # windows are lists of (doc, start, ids, tokens)

    def emit(self, window: list) -> Iterator[tuple]:
        number, at = self.next_id, 0
        self.next_id += 1
        length = sum(len(ids) // 4 for _, _, ids, _ in window)
        for doc, start, ids, tokens in window:
            yield doc, start, len(ids) // 4, zlib.crc32(ids), tokens, number, at, length
            at += len(ids) // 4

    def level_for(self, n: int) -> int:
        """The level whose choice minimises the sum of squared counts after the move."""
        counts = self.levels
        # Moving a window from h to h + n: (N_h - 1)^2 + (N_{h+n} + 1)^2 - N_h^2 - N_{h+n}^2.
        cost = 2 * (counts[n:] - counts[:self.width + 1 - n] + 1)
        cost[0] -= 2 * (0 - counts[0]) + 1  # a new window leaves no level: only N_n grows
        cost[-1] -= 2 * counts[-1] + 1  # a full window is not counted
        cost[1:][counts[1:self.width + 1 - n] == 0] = np.iinfo(np.int64).max
        # Among equal costs the fullest level wins.
        return int(len(cost) - 1 - np.argmin(cost[::-1]))

    def put(self, doc, ids: bytes) -> Iterator[tuple]:
        tokens, step = len(ids) // 4, 4 * self.width
        whole = len(ids) - len(ids) % step
        for a in range(0, whole, step):
            yield from self.emit([(doc, a // 4, ids[a:a + step], tokens)])
        n = (len(ids) - whole) // 4
        if not n:
            return
        level = self.level_for(n)
        window = self.open[level].pop() if level else []
        self.levels[level] -= bool(level)
        window.append((doc, whole // 4, ids[whole:], tokens))
        if level + n == self.width:
            yield from self.emit(window)
        else:
            self.open[level + n].append(window)
            self.levels[level + n] += 1

    def close(self) -> Iterator[tuple]:
        """Cut the lowest windows to fill the highest; the last one into powers of two."""
        rest = [(level, w) for level in range(self.width) for w in self.open[level]]
        low, fill = 0, 0
        while rest:
            level, window = rest.pop()
            while level < self.width and rest:
                low, donor = rest[0]
                piece = donor.pop()
                room = 4 * (self.width - level)
                taken, back = piece[2][:room], piece[2][room:]
                window.append((piece[0], piece[1], taken, piece[3]))
                level += len(taken) // 4
                if back:
                    donor.append((piece[0], piece[1] + len(taken) // 4, back, piece[3]))
                rest[0] = (low - len(taken) // 4, donor)
                if not donor:
                    rest.pop(0)
            if level == self.width:
                yield from self.emit(window)
                continue
            fill = level
            for bit in reversed(range(self.width.bit_length())):
                want, part = 4 * (fill & (1 << bit)), []
                while want:
                    doc, start, ids, tokens = window.pop(0)
                    part.append((doc, start, ids[:want], tokens))
                    if len(ids) > want:
                        window.insert(0, (doc, start + want // 4, ids[want:], tokens))
                    want -= min(want, len(ids))
                if part:
                    yield from self.emit(part)


def pack(docs: DataFrame, width: int = WIDTH, end_id: int = END_ID, tokenizer: str | None = None) -> DataFrame:
    """One row per piece of a document: where its ids stand in which window."""
    path = tokenizer or default_tokenizer()
    end = array("I", [end_id]).tobytes()

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path).encode
        packer = Packer(width, TaskContext.get().partitionId() << 33)

        def rows(pieces: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*pieces)], names=NAMES)

        for batch in batches:
            pieces = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                pieces.extend(packer.put(doc, encode(text.as_py() or "") + end))
                if len(pieces) > 20_000:
                    yield rows(pieces)
                    pieces = []
            if pieces:
                yield rows(pieces)
        pieces = list(packer.close())
        if pieces:
            yield rows(pieces)

    return docs.select("doc_id", "text").mapInArrow(task, SCHEMA)


def op2_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
