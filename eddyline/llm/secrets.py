"""Secret scans with a trigram inverted index in front of the regular expressions.

From each rule's pattern a Boolean trigram query is derived: alternatives (or) of trigrams that must all
occur (and), in ASCII lower case. Each block of documents gets its own inverted index, as search engines
keep one for each segment: the postings of the queries' trigrams are built in numpy from the block's
bytes, intersected and united by the query, and only the documents left are matched with the regular
expression. A rule without a mandatory trigram (an alternative that none is known of) scans every
document. The index changes no result, only the work; nothing is shuffled.

Spans count code points, end exclusive. The base kinds are assign, access and hex; ``EXTRA`` rules add
spans of their own kinds. Defined results: a null or empty text has no span; rows are scanned each.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from re import _constants as sre
from re import _parser as sre_parser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eddyline.llm.common import table
from eddyline.llm.hashing import blocks

#: Alternatives that a query may have; a pattern that needs more scans fully.
MOST_ALTERNATIVES = 64


def _runs(items, limit: int) -> list[list[str]] | None:
    """The alternatives of a parsed pattern, each a list of strings that it must contain; parts between
    which anything may stand are apart, so "" ends a run. None: too many alternatives."""
    ways: list[list[str]] = [[""]]

    def spread(more: list[list[str]]) -> list[list[str]]:
        return [[*w[:-1], w[-1] + m[0], *m[1:]] for w in ways for m in more]

    for op, arg in items:
        if op is sre.LITERAL:
            ways = spread([[chr(arg)]])
        elif op is sre.SUBPATTERN:
            inner = _runs(arg[3], limit)
            ways = spread(inner) if inner is not None else spread([["", ""]])
        elif op is sre.BRANCH:
            inner = [_runs(x, limit) for x in arg[1]]
            ways = spread([w for x in inner for w in x]) if None not in inner else spread([["", ""]])
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and arg[0] == 0 and arg[1] == 1:
            inner = _runs(arg[2], limit)
            ways = spread([[""], *inner]) if inner is not None else spread([["", ""]])
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and arg[0] >= 1:
            inner = _runs(arg[2], limit)
            ways = spread([[*w, "", *w] if arg[1] != 1 else w for w in inner]) if inner is not None else spread([["", ""]])
        elif op is sre.IN and len(arg) == 2 and all(a is sre.LITERAL for a, _ in arg) and len({chr(b).lower() for _, b in arg}) == 1:
            ways = spread([[chr(arg[0][1])]])
        elif op is sre.AT:
            continue
        else:
            ways = spread([["", ""]])
        if len(ways) > limit:
            return None
    return ways


def trigram_query(pattern: str) -> list[frozenset[str]] | None:
    """Alternatives, of each the trigrams that a match must contain; None if one has none."""
    ways = _runs(sre_parser.parse(pattern, re.ASCII), MOST_ALTERNATIVES)
    if ways is None:
        return None
    query = {frozenset(low[i : i + 3] for run in way for low in [run.lower()] if low.isascii() for i in range(len(low) - 2)) for way in ways}
    if frozenset() in query:
        return None
    return sorted((q for q in query if not any(o < q for o in query)), key=sorted)


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    group: int = 0  # the group whose length counts
    least: int = 1
    any_case: bool = False
    query: list[frozenset[str]] | None = field(init=False)

    def __post_init__(self):
        object.__setattr__(self, "query", trigram_query(self.pattern))

    def spans(self, text: str) -> list[tuple[int, int]]:
        found = re.finditer(self.pattern, text, re.ASCII | (re.IGNORECASE if self.any_case else 0))
        return [m.span() for m in found if m.end(self.group) - m.start(self.group) >= self.least]


BASE = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]+", 0, 24),
)
EXTRA = (
    Rule("pem", r"-----BEGIN (?:[A-Z]+ )?PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+"),
)
_LONG_HEX = re.compile(r"[0-9a-f]{24,}")


def _find(rule: Rule, text: str) -> list[tuple[int, int]]:
    if rule.pattern == r"[0-9a-f]+" and rule.least == 24:  # maximal runs, the short ones left out while matching
        return [m.span() for m in _LONG_HEX.finditer(text)]
    return rule.spans(text)


class Index:
    """Postings of the rules' trigrams over the rows of one column."""

    def __init__(self, column: pa.Array, rules: tuple[Rule, ...]):
        names = sorted({t for r in rules for way in r.query or () for t in way})
        code = np.array([int.from_bytes(t.encode(), "little") for t in names], np.uint32)
        order = np.argsort(code)
        code, slot = code[order], order
        first = np.zeros(1 << 16, bool)
        first[code & 0xFFFF] = True
        postings: list[list[np.ndarray]] = [[] for _ in names]
        for buf, rows, starts, origins in blocks(column):
            pair = buf[:-2].astype(np.uint16) | (buf[1:-1].astype(np.uint16) << 8)
            at = np.flatnonzero(first[pair])
            full = pair[at].astype(np.uint32) | (buf[at + 2].astype(np.uint32) << 16)
            k = np.searchsorted(code, full)
            k[k == len(code)] = 0
            hit = code[k] == full if len(code) else np.zeros(len(k), bool)
            own = rows[np.searchsorted(starts, at[hit], "right") - 1]
            key = np.unique(slot[k[hit]].astype(np.int64) * len(column) + own)
            for t, row in zip(*np.divmod(key, max(1, len(column))), strict=True):
                postings[t].append(row)
            # a text of several pieces is cut at white space or within a word: it counts as having all trigrams
            for row in np.unique(rows[(origins > 0)]):
                for p in postings:
                    p.append(row)
        self.rows = {t: np.unique(np.array(p, np.int64)) for t, p in zip(names, postings, strict=True)}
        self.all = np.arange(len(column))

    def candidates(self, rule: Rule) -> np.ndarray:
        if rule.query is None:
            return self.all
        found = []
        for way in rule.query:
            lists = sorted((self.rows[t] for t in way), key=len)
            left = lists[0]
            for other in lists[1:]:
                left = np.intersect1d(left, other, assume_unique=True)
            found.append(left)
        return np.unique(np.concatenate(found))


def scan(column: pa.Array, rules: tuple[Rule, ...]) -> list[list[tuple[str, int, int]]]:
    """(kind, start, end) of each row's spans, by start and then by the order of the rules."""
    index = Index(column, rules)
    out: list[list[tuple[int, int, int]]] = [[] for _ in range(len(column))]
    for k, rule in enumerate(rules):
        for row in index.candidates(rule).tolist():
            text = column[row].as_py()
            if text:
                out[row].extend((a, k, b) for a, b in _find(rule, text))
    return [[(rules[k].kind, a, b) for a, k, b in sorted(x)] for x in out]


def find_secrets(documents: DataFrame, rules: tuple[Rule, ...] = BASE + EXTRA) -> DataFrame:
    """doc_id and found, an array of (kind, start, end), a row for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            found = scan(batch["text"], rules)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array([[{"kind": a, "start": b, "end": c} for a, b, c in x] for x in found], kind)], ["doc_id", "found"])

    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, found array<struct<kind:string,start:bigint,end:bigint>>")


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(table(spark, sf_dir, "documents"))
    base = [r.kind for r in BASE]

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(kind):
        return F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    own = F.filter("found", lambda s: s["kind"].isin(base))
    return found.select("doc_id", *map(count, base), F.sha2(joined(own), 256).alias("base_sha256"), joined(F.col("found")).alias("spans"))


def redacted(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each stretch that spans cover, together where they overlap, replaced by its first kind."""
    out, done, i = [], 0, 0
    while i < len(spans):
        kind, a, b = spans[i]
        while i + 1 < len(spans) and spans[i + 1][1] < b:
            i += 1
            b = max(b, spans[i][2])
        out += [text[done:a], f"[{kind}]"]
        done, i = b, i + 1
    return "".join([*out, text[done:]])


def redact(spark: SparkSession, documents: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: every document stays, its secrets replaced; ``n_chars`` follows a changed text."""
    fields = documents.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch["text"]
            found = scan(column, BASE + EXTRA)
            texts, sizes = column.to_pylist(), batch["n_chars"].to_pylist()
            for i, spans in enumerate(found):
                if spans:
                    texts[i] = redacted(texts[i], spans)
                    sizes[i] = len(texts[i])
            new = {"text": pa.array(texts, column.type), "n_chars": pa.array(sizes, batch["n_chars"].type)}
            yield pa.RecordBatch.from_arrays([new.get(c, batch[c]) for c in batch.schema.names], batch.schema.names)

    return documents.mapInArrow(run, fields)
