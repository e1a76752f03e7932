"""Token counts of whole texts by byte-pair merging, without making the tokens.

A word starts as a linked list of its bytes; a heap holds its adjacent pairs by the rank of their merge. The lowest rank is
popped and merged until no pair can be. A word has as many tokens as bytes, less one for each merge. Words are independent
of each other, so a worker counts a word once while it remembers it. Nothing is shuffled.
"""

from __future__ import annotations

import functools
import heapq
import itertools
import json

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import releasing
from .packing import _WORDS, _odd, tokenizer_path

#: Bytes of words that a worker remembers (WORD for each beside its letters), in two halves: what wasn't met while a half filled is forgotten.
REMEMBERED, WORD = 64 << 20, 160
#: Words of a text that are held at a time.
AT_ONCE = 1 << 16


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in the vocabulary: itself if it prints, else the next one from U+0100 on."""
    prints = {b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174}
    free = itertools.count(256)
    return {b: chr(b if b in prints else next(free)) for b in range(256)}


def read_vocabulary(path: str) -> tuple[list[int], dict[tuple[int, int], tuple[int, int]], list[str]]:
    """(symbol of each byte, (rank, symbol) of each pair that merges, special strings) of a byte-level BPE file.

    Raises ValueError for files that do anything which counting here doesn't: another model, normalizers, prefix spaces, dropout,
    special tokens that take white space or whole words only.
    """
    with open(path, encoding="utf-8") as f:
        found = json.load(f)
    model, before = found["model"], found.get("pre_tokenizer") or {}
    specials = found.get("added_tokens") or []
    plain = model.get("type") == "BPE" and not any(model.get(x) for x in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
    plain &= before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and before.get("use_regex", True)
    plain &= not found.get("normalizer") and not any(t.get(x) for t in specials for x in ("single_word", "lstrip", "rstrip"))
    vocab = model["vocab"]
    letters = byte_letters()
    if not plain or any(x not in vocab for x in letters.values()):
        raise ValueError(f"{path} isn't a plain byte-level BPE")
    pairs = {}
    for rank, pair in enumerate(model["merges"]):
        a, b = pair.split(" ") if isinstance(pair, str) else pair
        pairs[vocab[a], vocab[b]] = (rank, vocab[a + b])
    return [vocab[letters[b]] for b in range(256)], pairs, [t["content"] for t in specials]


def count_merged(symbols: list[int], pairs: dict[tuple[int, int], tuple[int, int]]) -> int:
    """How many symbols are left of a word when no adjacent pair of it can be merged; the lowest rank goes first, then the first place."""
    n = left = len(symbols)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(hit[0], i, hit[1]) for i in range(n - 1) if (hit := pairs.get((symbols[i], symbols[i + 1])))]
    heapq.heapify(heap)
    while heap:
        rank, i, merged = heapq.heappop(heap)
        j = after[i]
        if symbols[i] < 0 or j >= n or pairs.get((symbols[i], symbols[j])) != (rank, merged):
            continue  # one of the two has been merged since
        symbols[i], symbols[j], after[i] = merged, -1, after[j]
        left -= 1
        if after[i] < n:
            before[after[i]] = i
            if hit := pairs.get((merged, symbols[after[i]])):
                heapq.heappush(heap, (hit[0], i, hit[1]))
        if (h := before[i]) >= 0 and (hit := pairs.get((symbols[h], merged))):
            heapq.heappush(heap, (hit[0], h, hit[1]))
    return left


class _Counter:
    def __init__(self, path: str):
        import public_tokenizers
        import regex

        self.bytes, self.pairs, special = read_vocabulary(path)
        self.exact = regex.compile(public_tokenizers.PATTERN).finditer
        # longer ones first, as the library takes the longest at a place
        self.special = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.new: dict[str, int] = {}
        self.old: dict[str, int] = {}
        self.held = 0

    def _word(self, word: str) -> int:
        n = self.old.get(word)
        if n is None:
            n = count_merged([self.bytes[b] for b in word.encode()], self.pairs)
        if len(word) < 256:
            self.held += WORD + 2 * len(word)
            if self.held > REMEMBERED // 2:
                self.old, self.new, self.held = self.new, {}, 0
            self.new[word] = n
        return n

    def _words(self, words: list[str]) -> int:
        counts = list(map(self.new.get, words))
        if None in counts:
            counts = [self.new.get(w) or self._word(w) if n is None else n for w, n in zip(words, counts)]
        return sum(counts)

    def _plain(self, text: str) -> int:
        if len(text) <= AT_ONCE and not any(map(_odd, set(text))):
            return self._words(_WORDS.findall(text))
        # the vocabulary's own pattern, which differs on few characters
        words = (m.group() for m in self.exact(text))
        total = 0
        while some := list(itertools.islice(words, AT_ONCE)):
            total += self._words(some)
        return total

    def __call__(self, text: str) -> int:
        if self.special is None or not self.special.search(text):
            return self._plain(text)
        parts = self.special.split(text)
        return len(parts) - 1 + sum(map(self._plain, parts))


@functools.lru_cache(maxsize=2)
def _counter(path: str) -> _Counter:
    """One for each Python worker, which Spark uses for many tasks."""
    return _Counter(path)


def count_tokens(docs: DataFrame, path: str | None = None, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) of each row: UTF-8 bytes, tokens as the vocabulary's library counts them, n_tokens > limit.

    A null text counts as empty: no bytes, no tokens. Special strings in texts are one token each, as is the library's default.
    Null ids and repeated rows come out as they went in, an empty table gives no rows, other columns are ignored. Whole texts
    are counted, however long: words are taken some at a time, so memory grows with the longest word only, not with the text.
    path has to be a byte-level BPE that every executor can open; others raise ValueError.
    """
    path = path or tokenizer_path()

    def run(batches):
        count = _counter(path)
        for batch in batches:
            # one text at a time: a batch may hold very long ones
            n = [count(x.as_py() or "") for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n, pa.int64())], names=["_id", "_bytes", "_tokens"])

    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).alias("_id"), text.alias("_text"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("_bytes"))
    schema = f"_id {rows.schema['_id'].dataType.simpleString()}, _bytes long, _tokens long"
    out = rows.mapInArrow(releasing(run), schema)
    return out.select(F.col("_id").alias(id_col), F.col("_bytes").alias("n_bytes"), F.col("_tokens").alias("n_tokens"), (F.col("_tokens") > limit).alias("over_limit"))
