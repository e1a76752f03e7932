"""Packing documents into sequences: first-fit decreasing over a tournament tree, in randomised groups.

Texts are tokenised where they are read; only lengths are shuffled. A document is cut into full sequences and a rest, and
the rests of a group are packed by first-fit decreasing.
"""

from __future__ import annotations

import functools
import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, releasing

LENGTH, EOT, GROUP = 2048, 1, 4096
#: Bytes of words and ids that a worker remembers (WORD for each beside its letters and ids); others are encoded again. Characters
#: that are encoded at a time, if no single text is longer.
REMEMBERED, WORD, AT_ONCE = 112 << 20, 200, 1_000_000


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


#: The tokenizer's own pattern in terms of the standard library, which is faster: the same but for the characters below. Words and
#: numbers come first, as they are the most frequent and never start with an apostrophe; words of A-Z and a-z alone before all.
_WORDS = re.compile(r" ?[a-zA-Z]++(?![^\W\d_])| ?[^\W\d_]+| ?\d+|'(?:[stmd]|re|ve|ll)| ?(?:[^\w\s]|_)+|\s+(?!\S)|\s+")


def _odd(c: str) -> bool:
    """Numbers that aren't decimal digits count as letters there, and four control characters as white space."""
    return (c.isnumeric() and not c.isdecimal()) or "\x1c" <= c <= "\x1f"


class _Encoder:
    """Ids by the tokenizer, which sees each distinct word once; a byte-level BPE never merges across its words."""

    def __init__(self, path: str):
        import public_tokenizers
        import regex
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # the cores are taken by Spark's tasks
        self.tok = Tokenizer.from_file(path)
        vocab = self.tok.get_vocab()
        #: Bytes of each token: a character of its name stands for one.
        self.bytes = np.zeros(max(vocab.values()) + 1, np.int64)
        self.bytes[list(vocab.values())] = list(map(len, vocab))
        #: Texts that hold one of these are left to the tokenizer as a whole.
        self.special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.exact = regex.compile(public_tokenizers.PATTERN).findall
        self.ids: dict[str, bytes] = {}
        self.held = 0

    def _encode(self, words: list[str]) -> list[bytes]:
        e = self.tok.encode_batch_fast([words], is_pretokenized=True, add_special_tokens=False)[0]
        ids = np.array(e.ids, dtype="<u4")
        ends, to = np.cumsum(self.bytes[ids]), np.cumsum(pc.binary_length(pa.array(words, pa.string())).to_numpy())
        cuts = np.searchsorted(ends, to, side="right")
        if not len(ids) or not np.array_equal(ends[cuts - 1], to):  # no plain byte-level tokens
            e = self.tok.encode(words, is_pretokenized=True, add_special_tokens=False)
            ids = np.array(e.ids, dtype="<u4")
            cuts = np.searchsorted(np.array(e.word_ids), np.arange(len(words)), side="right")
        raw, cuts = ids.tobytes(), [0, *(4 * cuts).tolist()]
        return [raw[a:z] for a, z in zip(cuts, cuts[1:])]

    def _gaps(self, split: list[list[str]], ids: list[list[bytes | None]]) -> list[tuple[list[bytes | None], int, str]]:
        """Where words have no ids yet: (list, place in it, word)."""
        out = []
        for s, x in zip(split, ids):
            i = -1
            for _ in range(x.count(None)):
                i = x.index(None, i + 1)
                out.append((x, i, s[i]))
        return out

    def __call__(self, texts: list[str]) -> list[bytes]:
        special = [i for i, t in enumerate(texts) if any(x in t for x in self.special)]
        if special:
            out = self([("" if i in special else t) for i, t in enumerate(texts)])
            for i in special:
                out[i] = np.array(self.tok.encode(texts[i], add_special_tokens=False).ids, dtype="<u4").tobytes()
            return out
        split = [_WORDS.findall(t) for t in texts]
        ids = [list(map(self.ids.get, s)) for s in split]
        gaps = self._gaps(split, ids)
        new = {w for _, _, w in gaps}
        odd = {c for c in set("".join(new)) if _odd(c)}
        if odd:  # words with such characters are never remembered, so they are new wherever they occur
            split = [self.exact(t) if odd.intersection(t) else s for t, s in zip(texts, split)]
            ids = [list(map(self.ids.get, s)) for s in split]
            gaps = self._gaps(split, ids)
            new = {w for _, _, w in gaps}
        if new:
            words = list(new)
            found = dict(zip(words, self._encode(words)))
            for x, i, w in gaps:
                x[i] = found[w]
            size = WORD * len(found) + 4 * sum(map(len, found)) + sum(map(len, found.values()))
            if self.held + size <= REMEMBERED:
                self.held += size
                self.ids.update({w: i for w, i in found.items() if not odd.intersection(w)} if odd else found)
        return list(map(b"".join, ids))


@functools.lru_cache(maxsize=2)
def _encoder(path: str) -> _Encoder:
    """One for each Python worker, which Spark uses for many tasks."""
    return _Encoder(path)


def tokenize(docs: DataFrame, path: str, length: int = LENGTH) -> DataFrame:
    """(doc_id, start, length, ids, doc_tokens): pieces of at most length tokens; ids are little-endian unsigned 32-bit.

    A null text counts as empty: it is the end token alone. Special tokens in texts become their ids, as the tokenizer has it. Very long texts are cut into many pieces; nothing is dropped.
    """
    schema = "doc_id long, start long, length long, ids binary, doc_tokens long"

    def run(batches):
        encode = _encoder(path)
        end = np.array([EOT], dtype="<u4").tobytes()
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            at = 0
            while at < len(ids):  # some MB of text at a time, whatever the batch holds
                to, size = at, 0
                while to < len(ids) and (to == at or size < AT_ONCE):
                    size += len(texts[to] or "")
                    to += 1
                out = []
                for d, b in zip(ids[at:to], encode([t or "" for t in texts[at:to]])):
                    b += end
                    n = len(b) // 4
                    out += [(d, s, min(length, n - s), b[4 * s : 4 * (s + length)], n) for s in range(0, n, length)]
                cols = list(zip(*out))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, pa.binary() if i == 3 else pa.int64()) for i, c in enumerate(cols)],
                    names=["doc_id", "start", "length", "ids", "doc_tokens"],
                )
                at = to

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(releasing(run), schema)


def first_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each item. Items go by falling size (ties by place), each into the first bin with room.

    The tree's leaves are bins, its inner nodes the most room below; going left wherever it suffices finds the first bin.
    """
    bins, offsets = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
    leaves = 1
    while leaves < max(1, len(sizes)):
        leaves *= 2
    room = [capacity] * (2 * leaves)
    for i in np.argsort(-sizes, kind="stable").tolist():
        need, node = int(sizes[i]), 1
        while node < leaves:
            node *= 2
            if room[node] < need:
                node += 1
        bins[i], offsets[i] = node - leaves, capacity - room[node]
        room[node] -= need
        while node > 1:
            node //= 2
            best = max(room[2 * node], room[2 * node + 1])
            if room[node] == best:
                break
            room[node] = best
    return bins, offsets


def pack(docs: DataFrame, path: str | None = None, length: int = LENGTH, group: int = GROUP, seed: int = 0) -> DataFrame:
    """(doc_id, start, length, ids, doc_tokens, sequence_id, offset): every token of every document in exactly one piece.

    Groups hold about `group` documents each, by a seeded hash of the row's place, so neither a repeated doc_id nor equal
    rows make one large. Repeated rows are packed each time. A null doc_id stays null. An empty table gives no rows.
    `ids` is computed before the shuffle; who doesn't select it doesn't move it.
    """
    pieces = tokenize(docs, path or tokenizer_path(), length)
    return assign(pieces, blocks(docs.count(), group), length, seed)


def assign(pieces: DataFrame, groups: int, length: int = LENGTH, seed: int = 0) -> DataFrame:
    """Give pieces their sequence_id and offset; all other columns are carried along."""
    place = F.pmod(F.xxhash64(F.lit(seed), F.monotonically_increasing_id()), F.lit(groups))
    kept = pieces.columns
    schema = ", ".join(f"`{n}` {t}" for n, t in pieces.dtypes) + ", sequence_id long, offset long"

    def run(key, t):
        t = t.select(kept)
        order = np.lexsort([t.column(c).to_numpy() for c in ("length", "start", "doc_id")])
        t = t.take(pa.array(order))
        bins, offsets = first_fit_decreasing(t.column("length").to_numpy(), length)
        ids = (np.int64(key[0].as_py()) << 32) + bins
        return t.append_column("sequence_id", pa.array(ids)).append_column("offset", pa.array(offsets))

    return pieces.withColumn("_group", place).groupBy("_group").applyInArrow(run, schema)
