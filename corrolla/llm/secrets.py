"""Secret scans: Boolean trigram queries from each rule's expression, postings of a block of texts, then the rule itself."""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass, field
from functools import lru_cache
from re import _constants as op, _parser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from corrolla.llm.common import read_documents, releasing, text_or_empty

#: Texts that one block's postings cover, and the code points it may hold (one longer text is a block by itself).
BLOCK_TEXTS, BLOCK_CHARS = 512, 4_000_000


@dataclass(frozen=True)
class Rule:
    """A kind, its expression, and the least length that a match, or the group `group` of it, must have."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    either_case: bool = False

    @property
    def compiled(self) -> re.Pattern:
        return re.compile(self.pattern, re.ASCII | (re.IGNORECASE if self.either_case else 0))


#: Fixed values. The base rules, then those that this operator adds; spans that start alike come in this order. An
#: expression may try no place of a long run again and again: the tests hold each to a time on a text of a megabyte.
BASE_RULES = (
    Rule("assign", r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 8, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", r"[0-9a-f]+", 0, 32),
)
MORE_RULES = (
    Rule("private_key", r"-----BEGIN (?:RSA |EC |DSA |OPENSSH |PGP )?PRIVATE KEY(?: BLOCK)?-----"),
    Rule("hub_token", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("cloud_key", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("pay_key", r"sk_live_[0-9a-zA-Z]{16,}"),
    Rule("web_token", r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("url_password", r"[A-Za-z][A-Za-z0-9+.-]{1,20}://[^\s/:@]{1,64}:[^\s/:@]{1,64}@"),
)
RULES = BASE_RULES + MORE_RULES


# ---- Boolean trigram queries: ("all",), ("and", {..}), ("or", {..}) or a trigram as bytes, all in lower case


ALL = ("all",)
#: Strings a sub-expression may stand for before it counts as free text.
MOST_STRINGS = 32


def _both(a, b):
    if a == ALL or a == b:
        return b
    if b == ALL:
        return a
    parts = (a[1] if a[0] == "and" else frozenset([a])) | (b[1] if b[0] == "and" else frozenset([b]))
    return ("and", parts)


def _either(queries):
    queries = frozenset(queries)
    if ALL in queries or not queries:
        return ALL
    return next(iter(queries)) if len(queries) == 1 else ("or", queries)


def _of_strings(strings):
    """What holds wherever one of these strings does."""
    out = []
    for s in strings:
        q = ALL
        for i in range(len(s) - 2):
            q = _both(q, ("tri", s[i : i + 3]))
        out.append(q)
    return _either(out)


class _Walk:
    """Walks a parsed expression, keeping the strings that the last stretch may be; whatever ends the stretch turns them into a query."""

    def __init__(self):
        self.query, self.strings = ALL, {b""}

    def cut(self):
        self.query, self.strings = _both(self.query, _of_strings(self.strings)), {b""}

    def add(self, strings):
        grown = {a + b for a in self.strings for b in strings}
        if len(grown) > MOST_STRINGS:
            self.cut()
            grown = set(strings)
        self.strings = grown

    def take(self, parsed) -> "_Walk":
        for kind, value in parsed:
            if kind is op.LITERAL:
                self.add({chr(value).lower().encode() if value < 128 else chr(value).encode()})
            elif kind is op.IN and (few := _few(value)):
                self.add(few)
            elif kind is op.SUBPATTERN:
                self.nested([value[-1]])
            elif kind is op.BRANCH:
                self.nested(value[1])
            elif kind in (op.MAX_REPEAT, op.MIN_REPEAT, op.POSSESSIVE_REPEAT):
                low, high, inner = value
                if (low, high) == (0, 1):
                    self.nested([inner, []])
                else:
                    if low:
                        self.cut()
                        self.query = _both(self.query, query_of(inner))
                    self.cut()
            elif kind is op.AT:
                continue
            else:
                self.cut()
        return self

    def nested(self, branches):
        walked = [_Walk().take(b) for b in branches]
        if all(w.query == ALL for w in walked):
            self.add(set().union(*(w.strings for w in walked)))
            return
        self.cut()
        self.query = _both(self.query, _either(_both(w.query, _of_strings(w.strings)) for w in walked))


def _few(items) -> set[bytes] | None:
    """The characters of a class of at most eight, in lower case."""
    out: set[bytes] = set()
    for kind, value in items:
        if kind is op.LITERAL:
            points = [value]
        elif kind is op.RANGE and value[1] - value[0] < 8:
            points = range(value[0], value[1] + 1)
        else:
            return None
        out |= {chr(p).lower().encode() for p in points}
    return out if len(out) <= 8 else None


def query_of(parsed):
    walk = _Walk().take(parsed)
    walk.cut()
    return walk.query


@lru_cache(maxsize=256)
def trigram_query(pattern: str):
    """A condition on a text's trigrams, ASCII letters in lower case, that holds wherever the expression matches."""
    return query_of(_parser.parse(pattern))


def trigrams_of(query) -> set[bytes]:
    if query[0] == "tri":
        return {query[1]}
    return set() if query == ALL else set().union(*(trigrams_of(x) for x in query[1]))


# ---- postings of a block


@dataclass
class Index:
    """Postings over a block of texts: for each trigram that some rule asks for, which texts hold it (a bitmap)."""

    rules: tuple[Rule, ...]
    queries: list = field(init=False)

    def __post_init__(self):
        self.queries = [trigram_query(r.pattern) for r in self.rules]
        self.vocabulary = sorted(set().union(*(trigrams_of(q) for q in self.queries)))
        self.slot = np.full(1 << 24, -1, dtype=np.int16)
        for i, t in enumerate(self.vocabulary):
            self.slot[t[0] << 16 | t[1] << 8 | t[2]] = i

    def postings(self, texts: list[bytes]) -> np.ndarray:
        """(trigrams, texts) booleans."""
        joined = b"\0\0".join(texts).lower()  # no trigram asked for holds two NULs, so none crosses a border
        raw = np.frombuffer(joined, dtype=np.uint8)
        out = np.zeros((len(self.vocabulary), len(texts)), dtype=bool)
        if len(raw) < 3:
            return out
        ends = np.cumsum([len(t) + 2 for t in texts])
        for at in range(0, len(raw) - 2, 1 << 20):  # bounded scratch for any text
            part = raw[at : at + (1 << 20) + 2].astype(np.int32)
            slots = self.slot[part[:-2] << 16 | part[1:-1] << 8 | part[2:]]
            hit = np.flatnonzero(slots >= 0)
            out[slots[hit], np.searchsorted(ends, hit + at, side="right")] = True
        return out

    def matching(self, query, postings: np.ndarray) -> np.ndarray:
        if query == ALL:
            return np.ones(postings.shape[1], dtype=bool)
        if query[0] == "tri":
            return postings[int(np.searchsorted(self.vocabulary, query[1]))]
        parts = [self.matching(x, postings) for x in query[1]]
        return np.logical_and.reduce(parts) if query[0] == "and" else np.logical_or.reduce(parts)

    def scan(self, texts: list[str]) -> list[list[tuple[int, int, int]]]:
        """For each text its spans (start, end, rule), by start and then by rule."""
        postings = self.postings([t.encode() for t in texts])
        found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        for k, (rule, query) in enumerate(zip(self.rules, self.queries)):
            pattern = rule.compiled
            for i in np.flatnonzero(self.matching(query, postings)):
                for m in pattern.finditer(texts[i]):
                    if m.end(rule.group) - m.start(rule.group) >= rule.least:
                        found[i].append((m.start(), m.end(), k))
        for spans in found:
            spans.sort(key=lambda s: (s[0], s[2], s[1]))
        return found


def blocks(texts: list[str]) -> Iterable[tuple[int, list[str]]]:
    """Runs of texts that are one block each, with the place of their first."""
    at = 0
    while at < len(texts):
        size, end = 0, at
        while end < len(texts) and end - at < BLOCK_TEXTS and (end == at or size + len(texts[end]) <= BLOCK_CHARS):
            size += len(texts[end])
            end += 1
        yield at, texts[at:end]
        at = end


def scan_documents(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col and spans, an array of (kind, start, end) in code points, by start and then by rule, for each row.

    A rule's matches are leftmost and do not overlap; those shorter than it asks for are dropped after matching. A rule
    whose expression has no trigram that every match must hold scans every text. Null or empty text has no spans; rows
    with null or repeated ids are scanned each by itself; further columns of docs play no part; an empty table gives an
    empty result.
    """
    rows = docs.select(F.col(id_col).alias("_id"), text_or_empty(text_col).alias("_text"))
    kind = docs.schema[id_col].dataType.simpleString()
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])

    def run(batches):
        index = Index(rules)  # by the task: made in a twentieth of a second, and its table takes 34 MB
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_TEXTS):
                part = batch.slice(at, BLOCK_TEXTS)
                spans: list = []
                for _, texts in blocks(part.column(1).to_pylist()):
                    spans += [[{"kind": rules[k].kind, "start": a, "end": b} for a, b, k in found] for found in index.scan(texts)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(spans, pa.list_(span))], names=[id_col, "spans"])

    return rows.mapInArrow(releasing(run), f"`{id_col}` {kind}, spans array<struct<kind:string,start:bigint,end:bigint>>")


def redact_documents(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text_col: str = "text", mark: str = "[{}]") -> DataFrame:
    """docs with every span of its text replaced by its kind in brackets; overlapping spans become one. Null stays null."""
    fields = docs.schema

    def run(batches):
        index = Index(rules)  # by the task: made in a twentieth of a second, and its table takes 34 MB
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_TEXTS):
                part = batch.slice(at, BLOCK_TEXTS)
                place = part.schema.get_field_index(text_col)
                values, out = part.column(place).to_pylist(), []
                for first, texts in blocks([v or "" for v in values]):
                    for i, (text, spans) in enumerate(zip(texts, index.scan(texts))):
                        pieces, end = [], 0
                        for a, b, k in spans:
                            if a >= end:
                                pieces += [text[end:a], mark.format(rules[k].kind)]
                            end = max(end, b)
                        out.append("".join([*pieces, text[end:]]) if values[first + i] is not None else None)
                columns = part.columns
                columns[place] = pa.array(out, part.schema.field(place).type)
                yield pa.RecordBatch.from_arrays(columns, schema=part.schema)

    return docs.mapInArrow(releasing(run), fields)


def op8_secret_scan(spark, sf_dir: str) -> DataFrame:
    base = [r.kind for r in BASE_RULES]
    found = scan_documents(read_documents(spark, sf_dir))
    said = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    own = F.filter("spans", lambda s: s["kind"].isin(base))
    of_kind = lambda k: F.filter("spans", lambda s: s["kind"] == k)
    counts = [F.size(of_kind(k)).cast("long").alias(f"n_{k}") for k in base]
    return found.select("doc_id", *counts, F.sha2(said(own).cast("binary"), 256).alias("base_sha256"), said(F.col("spans")).alias("spans"))
