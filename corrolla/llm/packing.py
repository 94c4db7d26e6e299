"""Packing token sequences: overlong documents are cut into full windows, what remains goes best fit, largest first."""

from __future__ import annotations

import json
import os
import zlib
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from corrolla.llm.common import numbered, read_documents, releasing, text_or_empty, written
from corrolla.llm.memo import WORD_PATTERN

#: Bytes of texts that are encoded at a time (one text at least): each word in them is encoded once.
SLICE = 8 << 20
#: Words of these characters are cut alike by both libraries, whatever Unicode tables they have.
PLAIN_WORD = "\\A[!-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff][\\t\\n\\r!-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]*\\z"
#: Bytes of a word beyond which it is left to the tokenizer, as the rank library's pattern steps back over long white space.
PLAIN_BYTES = 1000
#: Bytes of words that the tokenizer is given at a time (one word at least).
PART = 1 << 16
#: First words of texts, of 64 characters at most, that a worker remembers.
ROOM = 50_000
_TOKENIZERS: dict[str, object] = {}


def _byte_alphabet() -> dict[str, int]:
    """The characters that stand for bytes in a byte-level vocabulary: visible Latin-1 for itself, others from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    return {chr(b): b for b in shown} | {chr(0x100 + i): b for i, b in enumerate(x for x in range(256) if x not in shown)}


def _spans(texts: pa.Array, size: int):
    """(from, to) of consecutive runs of texts, of `size` bytes at most or a single text each."""
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < len(ends):
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + size, "right")))
        yield at, to
        at = to


class _Ids:
    """Token ids of texts, as little-endian unsigned 32-bit integers, equal to the tokenizer's for each whole text.

    Where every space precedes a visible character each word, with the space before, can be encoded apart. The distinct
    words of many texts are joined to one text, and its ids are cut at the words' ends, which are ends of tokens. Words
    that are plain (PLAIN_WORD) go through the rank library over the tokenizer's own vocabulary, if that has its merges
    in the order of its ids, all others through the tokenizer. Other texts, and all texts where the tokenizer's file
    isn't a plain byte-level one, go through the tokenizer whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # such strings in a text are ordinary text
        self.heads: dict[str, bytes] = {}
        self.widths = self.by_rank = None
        about = json.loads(self.tokenizer.to_str())
        model, before = about["model"], about.get("pre_tokenizer") or {}
        plain = before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and before.get("use_regex", True)
        if not plain or about.get("normalizer") or model.get("type") != "BPE" or model.get("dropout"):
            return
        byte, vocab = _byte_alphabet(), model["vocab"]
        if any(not byte.keys() >= set(t) for t in vocab) or not all(t.get("special") for t in about.get("added_tokens") or ()):
            return
        self.widths = np.zeros(max(vocab.values()) + 1, np.int64)  # bytes that each id stands for
        for t, i in vocab.items():
            self.widths[i] = len(t)
        self.by_rank = self._ranks(byte, vocab, model["merges"])

    def _ranks(self, byte: dict[str, int], vocab: dict[str, int], merges: list):
        """text -> ids by ranks, or None where ids don't follow the merges."""
        import tiktoken

        pairs = [m if isinstance(m, list) else m.split(" ") for m in merges]
        ranks = {bytes(byte[c] for c in t): i for t, i in vocab.items() if len(t) == 1}
        if len(ranks) != 256 or any(vocab.get(a + b) != 256 + i for i, (a, b) in enumerate(pairs)):
            return None
        ranks |= {bytes(byte[c] for c in a + b): 256 + i for i, (a, b) in enumerate(pairs)}
        return tiktoken.Encoding("pieces", pat_str=WORD_PATTERN, mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_ordinary

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _cut(self, words: pa.Array, encode) -> pa.LargeBinaryArray:
        """Ids of each word with a space before it: those of all words in one text, cut at the words' ends."""
        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words), " ")[0].as_py()
        ids = encode(" " + joined)
        ends = np.cumsum(pc.binary_length(words).to_numpy(zero_copy_only=False) + 1, dtype=np.int64)
        reached = np.cumsum(self.widths[ids])
        last = np.searchsorted(reached, ends)
        if len(reached) <= last[-1] or not np.array_equal(reached[last], ends):
            raise ValueError("a token lies across the border of two words")
        offsets = np.concatenate([[0], 4 * (last + 1)])
        return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(words), [None, pa.py_buffer(offsets), pa.py_buffer(ids)])

    def _by_rank(self, text: str) -> np.ndarray:
        return np.array(self.by_rank(text), np.uint32)

    def _by_tokenizer(self, text: str) -> np.ndarray:
        return np.frombuffer(self._encode([text])[0], np.uint32)

    def _of_words(self, words: pa.Array) -> pa.LargeBinaryArray:
        """Ids of each of the words, with a space before; null for those with which a text can't be cut."""
        n = len(words)
        quick = np.zeros(n, bool)
        if self.by_rank:
            short = pc.less_equal(pc.binary_length(words), PLAIN_BYTES)
            quick = pc.and_(pc.match_substring_regex(words, PLAIN_WORD), short).to_numpy(zero_copy_only=False)
        places, found = [np.flatnonzero(quick)], []
        if len(places[0]):
            found.append(self._cut(words.filter(pa.array(quick)), self._by_rank))
        other, never = [], []
        for i, word in zip(np.flatnonzero(~quick), words.filter(pa.array(~quick)).to_pylist()):
            (never if not word or word[0].isspace() else other).append(i)
        rest = words.take(pa.array(other, pa.int64()))
        for at, to in _spans(rest, PART):
            places.append(np.array(other[at:to]))
            found.append(self._cut(rest.slice(at, to - at), self._by_tokenizer))
        places.append(np.array(never, np.int64))
        found.append(pa.nulls(len(never), pa.large_binary()))
        order = np.empty(n, np.int64)
        order[np.concatenate(places)] = np.arange(n)
        return pa.concat_arrays(found).take(pa.array(order))

    def _of_heads(self, heads: list[str]) -> list[bytes]:
        """Ids of texts' first words, before which there is no space."""
        if len(self.heads) > ROOM:
            self.heads = {}
        new = list(set(heads).difference(self.heads))
        now = {}
        for at, to in _spans(pa.array(new, pa.string()), PART):
            now.update(zip(new[at:to], self._encode(new[at:to])))
        self.heads.update((h, ids) for h, ids in now.items() if len(h) <= 64)
        return [now[h] if h in now else self.heads[h] for h in heads]

    def of(self, texts: pa.Array | list[str]) -> list[bytes]:
        texts = texts.cast(pa.string()) if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        if self.widths is None:
            return [self._encode([t.as_py()])[0] for t in texts]
        words = pc.split_pattern(texts, " ")
        bounds, every = words.offsets.to_numpy() - words.offsets[0].as_py(), words.flatten()
        each = every.dictionary_encode()
        later = np.ones(len(every), bool)
        later[bounds[:-1]] = False
        which = each.indices.to_numpy()
        heads = self._of_heads(each.dictionary.take(pa.array(which[~later])).to_pylist())
        which = which[later]
        used = np.zeros(len(each.dictionary), bool)
        used[which] = True
        ids = self._of_words(each.dictionary.filter(pa.array(used))).take(pa.array((np.cumsum(used) - 1)[which]))
        bounds = bounds - np.arange(len(bounds))  # without the first words
        first, to = bounds[:-1], bounds[1:]
        lacking = np.concatenate([[0], np.cumsum(ids.is_null().to_numpy(zero_copy_only=False))])
        whole = lacking[first] < lacking[to]
        at = np.frombuffer(ids.buffers()[1], np.int64)[ids.offset : ids.offset + len(ids) + 1]
        data = memoryview(ids.buffers()[2] or b"")
        return [
            self._encode([texts[k].as_py()])[0] if apart else head + data[a:b]
            for k, (apart, head, a, b) in enumerate(zip(whole.tolist(), heads, at[first].tolist(), at[to].tolist()))
        ]


def token_pieces(
    docs: DataFrame, path: str, window: int, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True
) -> DataFrame:
    """Pieces of at most `window` ids: id_col, start, length, ids_crc32, doc_tokens (long) and, with_ids, ids (binary).

    A document's ids end with end_id, so that a null or empty text has one id. All pieces but the last are full.
    """
    rows = docs.select(F.col(id_col).alias("_id"), text_or_empty(text_col).alias("_text"))
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, start long, length long, ids_crc32 long, doc_tokens long" + (", ids binary" if with_ids else "")
    end = end_id.to_bytes(4, "little")

    def run(batches):
        if path not in _TOKENIZERS:
            _TOKENIZERS[path] = _Ids(path)
        own = _TOKENIZERS[path]
        for batch in batches:
            for at, to in _spans(batch.column(1), SLICE):
                part = batch.slice(at, to - at)
                out: list[list] = [[] for _ in range(6 if with_ids else 5)]
                which = []
                for k, ids in enumerate(own.of(part.column(1))):
                    ids += end
                    for start in range(0, len(ids), 4 * window):
                        piece = ids[start : start + 4 * window]
                        which.append(k)
                        for column, value in zip(out[1:], (start // 4, len(piece) // 4, zlib.crc32(piece), len(ids) // 4, piece)):
                            column.append(value)
                columns = [part.column(0).take(pa.array(which, pa.int64()))] + [pa.array(x, pa.int64()) for x in out[1:5]]
                if with_ids:
                    columns.append(pa.array(out[5], pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, names=[id_col, "start", "length", "ids_crc32", "doc_tokens", "ids"][: len(columns)])

    return rows.mapInArrow(releasing(run), schema)


class _Open:
    """Open windows by remaining capacity: a segment tree of counts over capacities finds the tightest that fits."""

    def __init__(self, window: int):
        self.base = 1 << window.bit_length()
        self.tree = [0] * (2 * self.base)
        self.runs: list[list[tuple[int, int]]] = [[] for _ in range(window + 1)]  # (first window, how many)

    def push(self, room: int, first: int, n: int) -> None:
        if n and room:
            self.runs[room].append((first, n))
            self._add(room, n)

    def pop(self, room: int) -> tuple[int, int]:
        first, n = self.runs[room].pop()
        self._add(room, -n)
        return first, n

    def _add(self, room: int, n: int) -> None:
        at = room + self.base
        while at:
            self.tree[at] += n
            at >>= 1

    def tightest(self, size: int) -> int | None:
        """The smallest capacity of at least size that some open window has."""
        at = size + self.base
        if self.tree[at]:
            return size
        while at > 1:
            if at % 2 == 0 and self.tree[at + 1]:
                at += 1
                break
            at >>= 1
        else:
            return None
        while at < self.base:
            at = 2 * at if self.tree[2 * at] else 2 * at + 1
        return at - self.base


def best_fit_decreasing(counts: dict[int, int], window: int) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over a histogram of lengths: exact, and as quick for any number of pieces.

    Equal pieces are placed as one run: a window that a piece went into is tighter than before, so it takes the next
    ones until none fits, then the next window does. Returns (length, rank_from, rank_to, per_window, sequence_from,
    offset): piece `rank` of its length goes to window sequence_from + (rank - rank_from) // per_window, at offset +
    (rank - rank_from) % per_window * length.
    """
    open_, out, new = _Open(window), [], 0
    for size in sorted(counts, reverse=True):
        left, rank = counts[size], 0
        while left:
            room = open_.tightest(size)
            if room is None:
                room = window
                per = room // size
                first, n = new, -(-left // per)
                new += n
            else:
                per = room // size
                first, n = open_.pop(room)
            used = min(n, -(-left // per))
            placed = min(left, used * per)
            out.append((size, rank, rank + placed, per, first, window - room))
            full, rest = divmod(placed, per)
            open_.push(room - per * size, first, full)
            if rest:
                open_.push(room - rest * size, first + full, 1)
            open_.push(room, first + used, n - used)
            rank, left = rank + placed, left - placed
    return out


def pack(pieces: DataFrame, window: int, id_col: str = "doc_id") -> DataFrame:
    """Give every piece a sequence_id (from 0) and its offset there. pieces: written, with id_col, start and length.

    Only the histogram of lengths, at most `window` rows, goes to the driver. A length may hold any share of the
    pieces: they are numbered in portions, see numbered().
    """
    spark: SparkSession = pieces.sparkSession
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    plan = spark.createDataFrame(
        best_fit_decreasing(counts, window), "length long, _from long, _to long, _per long, _sequence long, _offset long"
    )
    parts = max(64, min(1024, sum(counts.values()) // 200_000))
    ranked = numbered(pieces.withColumn("_by", F.struct(id_col, "start")), "length", "_rank", "_by", parts).drop("_by")
    j = F.col("_rank") - F.col("_from")
    within = (ranked["length"] == plan["length"]) & (ranked["_rank"] >= plan["_from"]) & (ranked["_rank"] < plan["_to"])
    return (
        ranked.join(F.broadcast(plan), within)  # at most a few runs for each of `window` lengths
        .drop(plan["length"])
        .withColumn("sequence_id", F.col("_sequence") + F.floor(j / F.col("_per")).cast("long"))
        .withColumn("offset", F.col("_offset") + j % F.col("_per") * F.col("length"))
        .drop("_rank", "_from", "_to", "_per", "_sequence", "_offset")
    )


def pack_documents(
    docs: DataFrame, path: str, window: int = 1024, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True
) -> DataFrame:
    """Pack all documents into sequences of at most `window` tokens; one row per piece.

    Null or empty text: the end id alone. Null and repeated ids are packed like others (rows alike in id, text and
    start are interchangeable). Very long texts become full windows and a rest. Further columns of docs play no part.
    An empty table gives an empty result.
    """
    return pack(written(token_pieces(docs, path, window, end_id, id_col, text_col, with_ids), "pieces"), window, id_col)


def sequences(packed: DataFrame, window: int = 1024, pad_id: int = 0) -> DataFrame:
    """The windows themselves: sequence_id, n_tokens and ids (binary, padded with pad_id). Each has `window` pieces at most."""
    pad = pad_id.to_bytes(4, "little").hex()
    joined = F.expr("array_join(transform(sort_array(collect_list(struct(offset, hex(ids) AS h))), x -> x.h), '')")
    out = packed.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), joined.alias("_hex"))
    filled = F.concat("_hex", F.repeat(F.lit(pad), (F.lit(window) - F.col("n_tokens")).cast("int")))
    return out.select("sequence_id", "n_tokens", F.unhex(filled).alias("ids"))


def op10_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(read_documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), 1024, with_ids=False)
