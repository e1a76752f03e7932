"""Licence scan: ordered signature rules behind a keyword prefilter, overlaps resolved by priority and containment."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .license_rules import Rule, rules

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}
#: Phrases whose places are counted, with their labels (fixed values).
BASE = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))
COLUMNS = (
    "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, "
    "detections array<struct<label: string, start: long, end: long, confidence: double>>"
)


class Scanner:
    """Compiled once for each task. Detections are (label, first word, word after the last, confidence)."""

    def __init__(self, rule_list: list[Rule] | None = None):
        import ahocorasick

        self.rules = rules() if rule_list is None else rule_list
        self.by_keyword: dict[str, list[int]] = defaultdict(list)
        for i, r in enumerate(self.rules):
            for k in r.keywords:
                self.by_keyword[k].append(i)
        self.keywords = ahocorasick.Automaton()
        for k in self.by_keyword:
            self.keywords.add_word(k, k)
        self.keywords.make_automaton()

    def detections(self, joined: str) -> list[tuple[str, int, int, float]]:
        """joined: words with one space before, between and after. Spans are places in it."""
        near = {k for _, k in self.keywords.iter(joined)}
        tiers: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
        for i in sorted({i for k in near for i in self.by_keyword[k]}):
            r = self.rules[i]
            tiers[r.tier] += [(m.start(), m.end(), i) for m in r.pattern.finditer(joined)]
        kept: list[tuple[int, int, int]] = []
        for tier in sorted(tiers):
            starts, furthest = [], []  # of what is kept: by start, with the furthest end so far
            for s, e, _ in sorted(kept):
                starts.append(s)
                furthest.append(max(e, furthest[-1]) if furthest else e)
            last = -1
            # within a tier the longer wins, then the earlier rule: by start, longest first, what doesn't reach further is inside
            for s, e, i in sorted(tiers[tier], key=lambda x: (x[0], -x[1], x[2])):
                at = bisect_right(starts, s)
                if e <= last or (at and furthest[at - 1] >= e):
                    continue
                last = e
                kept.append((s, e, i))
        return [(self.rules[i].label, s, e, self.rules[i].confidence) for s, e, i in sorted(kept)]

    def scan(self, text: str | None) -> tuple:
        words = WORD.findall((text or "").translate(LOWER))
        joined = f" {' '.join(words)} "
        n_base, first, last, base = 0, None, None, set()
        for phrase, label in BASE:
            n = joined.count(f" {phrase} ")
            if not n:
                continue
            n = sum(1 for _ in re.finditer(f"(?= {phrase} )", joined))  # places may share a space
            lo, hi = (joined.count(" ", 0, f(f" {phrase} ")) for f in (joined.find, joined.rfind))
            n_base += n
            base.add(label)
            first = lo if first is None else min(first, lo)
            last = hi if last is None else max(last, hi)
        found, at, word = [], 0, -1
        for label, s, e, confidence in self.detections(joined):  # by start: words are counted once
            word += joined.count(" ", at, s)
            at = s
            found.append({"label": label, "start": word, "end": word + joined.count(" ", s, e) + 1, "confidence": confidence})
        labels = base | {d["label"] for d in found}
        score = max([d["confidence"] for d in found], default=0.7 if base else 0.0)
        return len(words), n_base, first, last, ",".join(sorted(base)), ",".join(sorted(labels)), score, found


def scan_licenses(docs: DataFrame) -> DataFrame:
    """doc_id with the counts of base phrases, all labels, a score and the detections; one row for each row of docs.

    A null or empty text has 0 words, no labels and score 0. Whole texts are scanned where they are read; nothing is
    shuffled. Other columns of docs are ignored, repeated rows are each answered, an empty table gives no rows. first_word and last_word are null without a base phrase. score is the confidence of the best detection.
    """
    names = [c.split()[0] for c in COLUMNS.split(", detections")[0].split(", ")] + ["detections"]

    def run(batches):
        scanner = Scanner()
        for batch in batches:
            columns = list(zip(*map(scanner.scan, batch.column(1).to_pylist()))) or [()] * len(names)
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("confidence", pa.float64())]))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds))], names=["doc_id", *names])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, f"doc_id long, {COLUMNS}")
