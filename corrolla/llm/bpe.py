"""Byte-level BPE by longest matches and backtracking, linear in the text; and the way back."""

from __future__ import annotations

import base64
from array import array
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from corrolla.llm.common import read_documents, text_or_empty
from corrolla.llm.memo import LATIN_WORD, MARKS, WORD_PATTERN, Memo, space_chunks

#: Documents that a worker holds in encoded form at a time.
SLICE = 500
_CODECS: dict[tuple, "Codec"] = {}


def load_ranks(path: str) -> dict[bytes, int]:
    """A rank file: a token in base64 and its rank on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def _ranges(chars) -> str:
    """The body of a character class with exactly these characters."""
    points, out = sorted(map(ord, chars)), []
    for p in points:
        if out and out[-1][1] == p - 1:
            out[-1][1] = p
        else:
            out.append([p, p])
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in out)


@lru_cache(maxsize=8)
def pattern_parts(pattern: str) -> tuple[str, str, str]:
    """The pattern, the same with the rank library's own letters and digits spelled out, and a class of the code
    points on which the regular-expression library, which follows a later Unicode, differs ("" if none)."""
    import regex
    import tiktoken

    everything = "".join(chr(i) for i in range(0x110000) if not 0xD800 <= i <= 0xDFFF)
    single = {bytes([i]): i for i in range(256)}
    spelled, differ = pattern, set()
    for known in (r"\p{L}", r"\p{N}", r"\s"):
        theirs = tiktoken.Encoding("class", pat_str=known, mergeable_ranks=single, special_tokens={})
        a = set(bytes(theirs.encode_ordinary(everything)).decode())
        differ |= a ^ set(regex.findall(known, everything))
        body = _ranges(a)
        if known != r"\s":
            parts = spelled.split("[^")
            inside = [p.partition("]") for p in parts[1:]]
            spelled = parts[0].replace(known, f"[{body}]") + "".join(
                "[^" + a.replace(known, body) + sep + b.replace(known, f"[{body}]") for a, sep, b in inside
            )
    return pattern, spelled, f"[{_ranges(differ)}]" if differ else ""


class Codec:
    """Encoder and decoder over one rank table.

    Ranks are ids, and a merge's rank orders it. Bytes are read as Latin-1 characters, so that a string automaton finds
    the tokens. A token sequence is what the merges make if and only if each adjacent pair is what they make of its two
    tokens alone; the encoder takes the longest token at each place, shortens it until it goes with the one before,
    and otherwise steps back, never trying a place twice.
    """

    def __init__(self, ranks: dict[bytes, int], parts: tuple[str, str, str]):
        import ahocorasick
        import regex

        self.ranks = ranks
        self.words = {i: t for t, i in ranks.items()}
        self.lengths = {i: len(t) for t, i in ranks.items()}
        self.automaton = ahocorasick.Automaton()
        for t, i in ranks.items():
            self.automaton.add_word(t.decode("latin-1"), i)
        self.longest = max(self.lengths.values())
        self.latin = {t.decode("latin-1"): i for t, i in ranks.items()}
        self.shorter: dict[int, int | None] = {}
        for t, i in ranks.items():
            self.shorter[i] = next((ranks[t[:n]] for n in range(len(t) - 1, 0, -1) if t[:n] in ranks), None)
        self.merges: dict[tuple[int, int], int] = {}
        self.halves: dict[int, tuple[int, int]] = {}
        self.goes = lru_cache(maxsize=1 << 19)(self._goes)
        for i in sorted(self.words):
            self._learn(i)
        self.goes.cache_clear()
        plain, spelled, odd = parts
        self.find = regex.compile(plain).findall
        self.find_odd = regex.compile(spelled).findall
        self.is_odd = regex.compile(odd).search if odd else None
        self.by_space = plain == WORD_PATTERN
        self.piece_ids = Memo(self._piece, 200_000)
        self.chunk_ids = Memo(self._chunk, 400_000)

    def _learn(self, i: int) -> None:
        """Find the merge that makes token i: its two parts, each older, that the merges leave apart until then."""
        self.halves[i] = (i, i)
        word = self.words[i]
        left = self.shorter[i]
        while left is not None:
            right = self.ranks.get(word[self.lengths[left] :])
            if right is not None and left < i and right < i and self._goes(left, right):
                self.halves[i] = (left, right)
                self.merges[left, right] = i
                return
            left = self.shorter[left]

    def _goes(self, a: int, b: int) -> bool:
        """Whether the merges leave tokens a and b side by side: undo the later merge of the two sides step by step
        and see that no merge across the border would have come before it."""
        limit = float("inf")
        merges, halves = self.merges, self.halves
        while True:
            across = merges.get((a, b))
            if across is not None and across < limit:
                return False
            a_inner, b_inner = halves[a][1], halves[b][0]
            a_open, b_open = a_inner != a, b_inner != b
            if a_open and (a > b or not b_open):
                limit, a = a, a_inner
            elif b_open:
                limit, b = b + 1, b_inner
            else:
                return True

    def _first(self, text: str, at: int) -> int:
        """The longest token at a place: the trie's longest path from there, cut back to a token's end."""
        front = text[at : at + self.longest]
        n = self.automaton.longest_prefix(front)
        token = self.latin.get(front[:n])
        while token is None:
            n -= 1
            token = self.latin.get(front[:n])
            if token is None and not n:
                raise ValueError("the rank table can't spell this text")
        return token

    def _piece(self, piece: str) -> bytes:
        raw = piece.encode()
        whole = self.ranks.get(raw)
        if whole is not None:
            return array("I", (whole,)).tobytes()
        text, n = raw.decode("latin-1"), len(raw)
        lengths, shorter, goes, first = self.lengths, self.shorter, self.goes, self._first
        fresh = bytearray(b"\1") * (n + 1)
        out: list[int] = []
        at, token = 0, first(text, 0)
        while at < n:
            last = out[-1] if out else None
            while True:
                end = at + lengths[token]
                if fresh[end] and (last is None or goes(last, token)):
                    out.append(token)
                    at = end
                    token = first(text, at) if at < n else None
                    break
                token = shorter[token]
                if token is None:
                    if last is None:
                        raise ValueError("the rank table can't spell this text")
                    fresh[at] = 0
                    out.pop()
                    at -= lengths[last]
                    token = last
                    break
        return array("I", out).tobytes()

    def _pieces(self, text: str) -> list[str]:
        odd = self.is_odd is not None and not text.isascii() and self.is_odd(text)
        return self.find_odd(text) if odd else self.find(text)

    def _chunk(self, chunk: str) -> bytes:
        if word := LATIN_WORD.match(chunk):
            end = word.end()
            if end == len(chunk):
                return self.piece_ids[chunk]
            if chunk[end:] in MARKS:
                return self.piece_ids[chunk[:end]] + self.piece_ids[chunk[end:]]
        return b"".join([self.piece_ids[p] for p in self._pieces(chunk)])

    def encode(self, text: str) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit integers."""
        chunks = space_chunks(text) if self.by_space else None
        if chunks is None:
            return b"".join(map(self.piece_ids.__getitem__, self._pieces(text)))
        return b"".join(map(self.chunk_ids.__getitem__, chunks))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.words.__getitem__, memoryview(ids).cast("I") if ids else ()))


def codec(path: str, parts: tuple[str, str, str]) -> Codec:
    """This worker's codec for a rank file; built once and kept."""
    key = (path, parts[0])
    if key not in _CODECS:
        _CODECS[key] = Codec(load_ranks(path), parts)
    return _CODECS[key]


def encode_documents(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", decoded: bool = False) -> DataFrame:
    """id_col and ids (binary: little-endian unsigned 32-bit) for each row; with decoded, the bytes the ids stand for.

    Each match of the pattern is encoded by itself, without special tokens. Null text counts as empty and has no ids;
    rows with null or repeated ids are encoded each by itself, further columns of docs play no part, an empty table
    gives an empty result. A text is held whole, a few hundred texts at a time.
    """
    parts = pattern_parts(pattern)
    rows = docs.select(F.col(id_col).alias("_id"), text_or_empty(text_col).alias("_text"))
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, ids binary" + (", decoded binary" if decoded else "")

    def run(batches):
        own = codec(path, parts)
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                ids = [own.encode(t) for t in part.column(1).to_pylist()]
                columns = [part.column(0), pa.array(ids, pa.binary())]
                if decoded:
                    columns.append(pa.array([own.decode(x) for x in ids], pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, names=[id_col, "ids", "decoded"][: len(columns)])

    return rows.mapInArrow(run, schema)


def op4_bpe(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    done = encode_documents(read_documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, decoded=True)
    return done.select(
        "doc_id",
        F.floor(F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
