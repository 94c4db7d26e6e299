"""Substring dedup: compact windows of token min-hashes, joined by what they share, then verified passage by passage."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from corrolla.llm.common import discard, join_skewed, read_documents, releasing, send_small, text_or_empty, tidy, written
from corrolla.llm.shingles import mix, set_digest, shingle_values, shingles_of_texts, word_values, words_of_texts

SLICE = 128
#: Windows of one key that one side of a block holds, and those that a window is held against at once.
BLOCK, TILE = 2048, 512
#: Windows looked at together, those with most in common first, until one is alike.
CLOSEST = 32
#: Windows in common from which two texts are compared without a look at the windows: an exact repeat has one for each hash.
SURE = 4
_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _over(values: np.ndarray, size: int, least) -> np.ndarray:
    """least (a ufunc such as np.minimum) over each stretch of `size` values, by doubling."""
    have = 1
    while have < size:
        step = min(have, size - have)
        values = least(values[: len(values) - step], values[step:])
        have += step
    return values


def compact_windows(shingles: np.ndarray, starts: np.ndarray, hashes: int, least: int) -> tuple[np.ndarray, ...]:
    """The compact windows of at least `least` shingles of the texts that lie one after the other in shingles, text i from
    starts[i] to starts[i + 1]: arrays text, key, place, first, last (places within the text).

    For each hash, a window is a node of the text's Cartesian tree: the longest stretch whose least value is the value at
    its place, so each sequence of `least` or more shingles has its min-hash in one window. Only stretches of `least`
    are looked at: runs of stretches with the same least value, nested by a stack of their values. Where a value occurs
    again in its window, the outer window comes once for every `least` stretches that it is the least of, not for every
    occurrence. A key is the hash value with the hash's number, up to 7, in its last three bits.
    """
    found: list[list[np.ndarray]] = [[], [], [], [], []]
    n = len(shingles) - least + 1
    if n < 1:
        return tuple(np.zeros(0, np.int64) for _ in found)
    text = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    inside = text[:n] == text[least - 1 :]
    if not inside.any():
        return tuple(np.zeros(0, np.int64) for _ in found)
    for k in range(hashes):
        values = mix(shingles ^ np.uint64(0xA0761D6478BD642F * (k + 1) & (1 << 64) - 1))
        lows = _over(values, least, np.minimum)
        new = np.r_[True, (lows[1:] != lows[:-1]) | (text[1:n] != text[: n - 1]) | (inside[1:] != inside[:-1])]
        run = np.flatnonzero(new)
        run_end = np.r_[run[1:], n]
        run, run_end = run[inside[run]], run_end[inside[run]]
        first, last = _nested(lows[run].tolist(), text[run].tolist(), run.tolist(), run_end.tolist())
        parts = (run_end - run + least - 1) // least  # a long run holds its value again and again
        of = np.repeat(np.arange(len(run)), parts)
        at = run[of] + least * (np.arange(len(of)) - np.repeat(np.cumsum(parts) - parts, parts))
        place = at + values[at[:, None] + np.arange(least)].argmin(axis=1)
        base = starts[text[at]]
        key = (values[place] & ~np.uint64(7) | np.uint64(k)).view(np.int64)
        for x, y in zip(found, (text[at], key, place - base, np.array(first)[of] - base, np.array(last)[of] + least - 1 - base)):
            x.append(y)
    return tuple(np.concatenate(x) for x in found)


def _nested(lows: list, texts: list, starts: list, ends: list) -> tuple[list, list]:
    """The first and last stretch of each run's window: as far as no stretch of its text has a smaller value."""
    n = len(lows)
    first, last, same = [0] * n, [0] * n, [-1] * n  # same: the run before with the same window
    values: list = []  # a stack of windows that are not closed: value, first stretch, latest run
    begins: list = []
    runs: list = []

    def close(end: int) -> int:
        values.pop()
        run = runs.pop()
        while run >= 0:
            last[run] = end
            run = same[run]
        return begins.pop()

    for i, (value, text, start) in enumerate(zip(lows, texts, starts)):
        if i and texts[i - 1] != text:
            while values:
                close(ends[i - 1] - 1)
        begin = start
        while values and values[-1] > value:
            begin = close(start - 1)
        if values and values[-1] == value:
            same[i], runs[-1], begin = runs[-1], i, begins[-1]
        else:
            values.append(value)
            begins.append(begin)
            runs.append(i)
        first[i] = begin
    while values:
        close(ends[-1] - 1)
    return first, last


def _common_run(a: np.ndarray, b: np.ndarray) -> int:
    """How many values two sequences share from their starts."""
    n, at, step = min(len(a), len(b)), 0, 64
    while at < n:
        end = min(n, at + step)
        differ = np.flatnonzero(a[at:end] != b[at:end])
        if len(differ):
            return at + int(differ[0])
        at, step = end, 2 * step
    return n


def _chains(a: np.ndarray, b: np.ndarray, slack: int) -> list[list[tuple[int, int, int]]]:
    """Chains of runs of equal shingles (first in a, first in b, length), each run drawn out to both sides as far as the
    texts agree. At a place of b, every chain that ended at most `slack` shingles before goes on where a has the shingle
    next to the chain's diagonal, at most `slack` off; where none holds the place, its first place in a begins a chain."""
    order = np.argsort(a, kind="stable")
    ranked = a[order]
    low, high = np.searchsorted(ranked, b), np.searchsorted(ranked, b, side="right")
    places = np.flatnonzero(low < high)
    out, live, k = [], [], 0

    def run(i, j):
        after, before = _common_run(a[i:], b[j:]), _common_run(a[:i][::-1], b[:j][::-1])
        return i - before, j - before, after + before

    while k < len(places):
        j = int(places[k])
        live = [c for c in live if c[-1][1] + c[-1][2] + slack >= j]
        held = False
        for chain in live:
            x = chain[-1]
            if j < x[1] + x[2]:
                held = True
                continue
            at, want = order[low[j] : high[j]], j + x[0] - x[1]
            p = int(np.searchsorted(at, want))
            near = [int(i) for i in at[max(0, p - 1) : p + 1] if abs(int(i) - want) <= slack and 0 <= int(i) - x[0] - x[2] + slack]
            if near:
                y = run(min(near, key=lambda i: abs(i - want)), j)
                if not any(y == c[-1] for c in live):
                    chain.append(y)
                held = True
        if not held:
            live.append([run(int(order[low[j]]), j)])
            out.append(live[-1])
        ends = [c[-1][1] + c[-1][2] for c in live if c[-1][1] + c[-1][2] > j]
        k = max(k + 1, int(np.searchsorted(places, min(ends)))) if ends else k + 1
    return out


def shared_passages(a: np.ndarray, b: np.ndarray, size: int, percent: int, min_words: int, slack: int = 12) -> list[tuple[int, int, int, int]]:
    """Passages of two texts, given as shingle values, that are alike: (first in a, last in a, first in b, last in b).

    Runs of equal shingles are chained along their diagonals while neither text skips more than `slack` shingles in between; a chain counts if
    its passages have min_words words and their shingle sets 100 * intersection >= percent * union; of one that does not
    the longest part that is alike by its runs is taken, or else it is cut at its widest gap, and the parts are tried.
    """
    if not len(a) or not len(b):
        return []
    out, stack = [], []
    for runs in _chains(a, b, slack):
        jump = [max(y[1] - x[1] - x[2], abs((y[0] - y[1]) - (x[0] - x[1]))) for x, y in zip(runs, runs[1:])]
        bounds = [0, *(k + 1 for k, w in enumerate(jump) if w > slack), len(runs)]
        stack += [(runs, jump, x, y) for x, y in zip(bounds, bounds[1:])]
    while stack:
        runs, jump, x, y = stack.pop()
        if x >= y:
            continue
        part = runs[x:y]
        from_, to = min(r[0] for r in part), max(r[0] + r[2] for r in part) - 1
        first, last = min(r[1] for r in part), max(r[1] + r[2] for r in part) - 1
        if min(to - from_, last - first) + size < min_words:
            continue
        mine, theirs = np.unique(b[first : last + 1]), np.unique(a[from_ : to + 1])
        both = len(np.intersect1d(mine, theirs, assume_unique=True))
        if 100 * both >= percent * (len(mine) + len(theirs) - both):
            out.append((from_, to, first, last))
        elif y - x > 1:
            i, j = _longest_alike(part, percent)
            if (i, j) == (0, y - x):  # alike by its runs, but not as sets
                i = j = 1 + max(range(y - x - 1), key=lambda k: jump[x + k])
            stack += [(runs, jump, x, x + i), (runs, jump, x + i, x + j), (runs, jump, x + j, y)]
    return out


def _longest_alike(runs: list[tuple[int, int, int]], percent: int) -> tuple[int, int]:
    """The longest stretch of runs (from, to) whose lengths add up to enough of the passages that they span; where there is
    none, all of them. A passage of a and one of b with h shingles in common are alike if h >= share * (their lengths)."""
    share = percent / (100 + percent)
    a, b, n = np.array(runs, dtype=np.int64).T
    gaps = np.maximum(0, a[1:] - a[:-1] - n[:-1]) + np.maximum(0, b[1:] - b[:-1] - n[:-1])
    ends = np.cumsum((1 - 2 * share) * n) - share * np.concatenate([[0], np.cumsum(gaps)])
    starts = ends - (1 - 2 * share) * n
    first = np.searchsorted(-np.minimum.accumulate(starts), -ends - 1e-9)  # the first run from which each may be reached
    last = np.arange(len(n))
    first = np.minimum(first, last)
    wide = np.where(first < last, b + n - b[first], 0)
    k = int(wide.argmax())
    return (int(first[k]), k + 1) if wide[k] else (0, len(n))


def _distinct(values: np.ndarray, size: int) -> np.ndarray:
    """How many distinct values each stretch of `size` has (of all, if there are fewer)."""
    n = len(values)
    size = min(size, n)
    order = np.argsort(values, kind="stable")
    next_ = np.full(n, n)
    same = values[order[1:]] == values[order[:-1]]
    next_[order[:-1][same]] = order[1:][same]
    # a place counts in the stretches that hold it and not its value's next place
    change = np.zeros(n + 1, dtype=np.int64)
    place = np.arange(n)
    start, end = np.maximum(0, place - size + 1), np.minimum(place, np.minimum(next_ - size, n - size))
    ok = start <= end
    np.add.at(change, start[ok], 1)
    np.add.at(change, end[ok] + 1, -1)
    return np.cumsum(change)[: n - size + 1]


def _fewest(values: np.ndarray, least: int) -> int:
    """Distinct shingles of the stretch of `least` that has fewest: no passage in these has fewer."""
    return min(least, len(values)) if len(np.unique(values)) == len(values) else int(_distinct(values, least).min())


def _dense(hits: np.ndarray, place: int, least: int, slack: int = 12) -> int:
    """Most hits in a stretch of `least` places, if the hits around place, with gaps of `slack` at most, reach over `least`
    places; else 0. Runs that shared_passages chains are such hits."""
    at = np.flatnonzero(hits)
    i = int(np.searchsorted(at, place))
    gaps = np.flatnonzero(np.diff(at) > slack + 1)
    k = int(np.searchsorted(gaps, i))
    first, last = (int(at[gaps[k - 1] + 1]) if k else int(at[0])), (int(at[gaps[k]]) if k < len(gaps) else int(at[-1]))
    if last - first + 1 < least:
        return 0
    sums = np.cumsum(np.r_[0, hits[first : last + 1]])
    return int((sums[least:] - sums[:-least]).max())


def text_hash(words: np.ndarray) -> int:
    """Tells the texts of one id apart: the first eight bytes of the digest of a text's words."""
    return int.from_bytes(set_digest(words)[:8], "little", signed=True)


def _scanned(docs: DataFrame, words: int, hashes: int, min_words: int, id_col: str, text_col: str) -> DataFrame:
    """A row for each text of min_words words or more with an id: _id, _t (text_hash), n (words), digest, fewest (see
    _fewest), prints (8 bits of each shingle), wide (16 bits), keys and ats of its windows. An at holds a window's place, and how
    far it reaches to the left and right of it, at most `least` - 1 each."""
    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("_id"), text_or_empty(text_col).alias("_text"))
    kind = docs.schema[id_col].dataType.simpleString()
    least = max(1, min_words - words + 1)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                every, starts = words_of_texts(part.column(1))
                full = np.diff(starts) >= min_words
                own = [every[a:b] for a, b, ok in zip(starts[:-1].tolist(), starts[1:].tolist(), full) if ok]
                every = np.concatenate([*own, np.zeros(0, np.uint64)])
                shingles, starts = shingles_of_texts(every, np.cumsum([0, *map(len, own)]), words)
                text, key, place, first, last = compact_windows(shingles, starts, hashes, least)
                order = np.argsort(text, kind="stable")
                reach = lambda x: np.minimum(x, least - 1).clip(0, 65535)
                ats = place << 32 | reach(place - first) << 16 | reach(last - place)
                cuts = np.searchsorted(text[order], np.arange(len(own) + 1)).astype(np.int32)
                listed = lambda x: pa.ListArray.from_arrays(pa.array(cuts), pa.array(x[order]))
                digests = [set_digest(w) for w in own]
                short, wide = (shingles >> np.uint64(56)).astype(np.uint8), (shingles >> np.uint64(48)).astype(np.uint16)
                each = list(zip(starts[:-1].tolist(), starts[1:].tolist()))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).filter(pa.array(full)),
                        pa.array([int.from_bytes(d[:8], "little", signed=True) for d in digests], pa.int64()),
                        pa.array([len(w) for w in own], pa.int32()),
                        pa.array(digests, pa.binary()),
                        pa.array([_fewest(shingles[a:b], least) for a, b in each], pa.int32()),
                        pa.array([short[a:b].tobytes() for a, b in each], pa.binary()),
                        pa.array([wide[a:b].tobytes() for a, b in each], pa.binary()),
                        listed(key),
                        listed(ats),
                    ],
                    names=["_id", "_t", "n", "digest", "fewest", "prints", "wide", "keys", "ats"],
                )

    return rows.mapInArrow(releasing(run), f"_id {kind}, _t long, n int, digest binary, fewest int, prints binary, wide binary, keys array<long>, ats array<long>")


def _numbered(signed: DataFrame) -> DataFrame:
    """signed (one row for each _id and _t) with _u, a long that orders the texts as (_id, _t) do: the id itself where it
    is a number and has one text, else places in the sorted table."""
    if signed.schema["_id"].dataType.typeName() in ("byte", "short", "integer", "long"):
        if not signed.groupBy("_id").agg(F.count(F.lit(1)).alias("c")).where("c > 1").take(1):
            return signed.withColumn("_u", F.col("_id").cast("long"))
    units = signed.select("_id", "_t").distinct()
    units = written(units.orderBy("_id", "_t").withColumn("_u", F.monotonically_increasing_id()), "order")
    return signed.dropDuplicates(["_id", "_t"]).join(units, ["_id", "_t"])


def _earliest_alike(rows: dict[str, list], words: int, percent: int, min_words: int) -> list[tuple]:
    """For the open windows of one block, one earlier text's window of another part with a passage alike that holds the
    window's place (a block of a single part gives each row a part of its own), and less the shingles in common; all told
    by 16 bits of each shingle.

    Every open window is held against every earlier one, TILE of them at once: the shingles in common are counted in a table
    of the tile's sets. Those with enough are looked at closely, those with most in common first, until one has a passage alike.
    """
    prints, least = [np.frombuffer(x, np.uint16) for x in rows["prints"]], max(1, min_words - words + 1)
    rank, part, place = (np.array(rows[c]) for c in ("_u", "part", "place"))
    open_ = np.flatnonzero(np.array(rows["open"], dtype=bool))
    if not len(open_) or (rank == rank[0]).all():
        return []
    length = np.array([len(p) for p in prints])
    owner, at = np.repeat(np.arange(len(prints)), length), np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
    _, column = np.unique(np.concatenate(prints), return_inverse=True)
    width = int(column.max()) + 1
    columns = np.full((len(prints), max(2 * least - 1, int(length.max()))), width)  # of each place, the print's column; none beyond the end
    columns[owner, at] = column
    ordered = np.sort(columns, axis=1)
    several = ((ordered[:, 1:] == ordered[:, :-1]) & (ordered[:, 1:] < width)).any(axis=1)
    fewest = np.array([int(_distinct(p, least).min()) if more else min(least, len(p)) for p, more in zip(prints, several)])
    new = columns < width  # places whose shingle the row doesn't have before: no stretch has fewer distinct ones
    for i in np.flatnonzero(several):
        new[i, : length[i]] = False
        new[i, np.unique(columns[i, : length[i]], return_index=True)[1]] = True
    share = percent / (100 + percent)  # shared shingles of two sets alike are at least this part of their sizes' sum
    # only shingles of two rows or more can be in common
    holders = np.bincount(columns[new], minlength=width)
    number = np.append(np.where(holders > 1, np.cumsum(holders > 1) - 1, -1), -1)
    width = int((holders > 1).sum())
    columns = number[columns]
    columns[columns < 0] = width
    own = [columns[i][new[i] & (columns[i] < width)] for i in range(len(prints))]
    new |= np.arange(columns.shape[1]) >= length[:, None]  # beyond the end nothing is alike
    count_type = np.uint8 if columns.shape[1] < 256 else np.uint32
    able: dict[int, list] = {int(i): [] for i in open_}
    two = len(np.unique(part)) == 2  # a side is held against the other one alone
    for side in [np.flatnonzero(part == p) for p in np.unique(part)] if two else [np.arange(len(part))]:
        order = side[np.argsort(rank[side], kind="stable")]
        against = open_[part[open_] != part[side[0]]] if two else open_
        for tile in [order[start : start + TILE] for start in range(0, len(order), TILE)]:
            table = np.zeros((width, len(tile)), dtype=np.uint8)
            for k, j in enumerate(tile):
                table[own[j], k] = 1
            low, first = fewest[tile].min(), rank[tile[0]]
            for i in against:
                least_count = share * (low + fewest[i]) - 1e-9
                if rank[i] <= first or len(own[i]) < least_count:
                    continue
                count = table[own[i]].sum(axis=0, dtype=count_type)
                keep = np.flatnonzero(count >= least_count)
                if len(keep):
                    j = tile[keep]
                    ok = (count[keep] >= share * (fewest[j] + fewest[i]) - 1e-9) & (rank[j] < rank[i]) & (part[j] != part[i])
                    if ok.any():
                        able[int(i)].append((j[ok], count[keep][ok].astype(np.int64)))

    def reaches(hits: np.ndarray, distinct: np.ndarray, part: float) -> np.ndarray:
        """Of each row, whether some stretch of `least` places or more has hits for at least this part of its distinct ones."""
        sums = np.zeros((len(hits), hits.shape[1] + 1))
        np.cumsum(hits - part * distinct, axis=1, out=sums[:, 1:])
        return (sums[:, least:] - np.minimum.accumulate(sums[:, :-least], axis=1)).max(axis=1) >= -1e-9

    out, left, slot = [], rows["left"], np.zeros(width + 1, dtype=np.int64)
    for i, found in able.items():
        if not found:
            continue
        js, count = (np.concatenate(x) for x in zip(*found))
        best = np.lexsort((rank[js], -count))
        js, count = js[best], count[best]
        slot[own[i]] = np.arange(1, len(own[i]) + 1)
        y, hit = prints[i].astype(np.uint64), None
        for start in range(0, len(js), CLOSEST):
            some = js[start : start + CLOSEST]
            at = slot[columns[some]]  # which of i's shingles stands at each place, from 1
            has = np.zeros((len(some), len(own[i]) + 1), dtype=bool)
            has[np.arange(len(some))[:, None], at] = True
            has[:, 0] = False
            mine, other = has[:, slot[columns[i]]], at > 0
            # either stretch alike has `percent` of its shingles in the other, and one of the two has 2 * share
            keep = reaches(mine, new[[i]], percent / 100) & reaches(other, new[some], percent / 100)
            keep &= reaches(mine, new[[i]], 2 * share) | reaches(other, new[some], 2 * share)
            for k in np.flatnonzero(keep):
                j = int(some[k])
                if not _dense(mine[k][: length[i]], left[i], least) or not _dense(other[k][: length[j]], left[j], least):
                    continue
                if any(f <= left[i] <= t for _, _, f, t in shared_passages(prints[j].astype(np.uint64), y, words, percent, min_words)):
                    hit = (-int(count[start + k]), int(rank[j]), int(place[j]), int(rank[i]), int(place[i]))
                    break
            if hit:
                out.append(hit)
                break
        slot[own[i]] = 0
    return out


def substring_duplicates(
    docs: DataFrame,
    words: int = 5,
    percent: int = 80,
    min_words: int = 50,
    hashes: int = 4,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Passages of at least min_words words that repeat one of an earlier text, texts being in order of (id, text_hash).

    Returns id_col, start_word, end_word (exclusive), source_id and text_hash, merged where they overlap, with the smallest
    source; the words are [^\\x20\\x09-\\x0D]+, compared with A-Z in lower case. Two passages are alike if their sets of
    `words`-word shingles have 100 * intersection >= percent * union.

    Compact windows of different texts meet where they share the key of one hash (8 hashes at most). An exact repeat does
    so for every hash; of passages with similarity 0.9 one of four hashes agrees with a probability of 0.9999, with 0.8 of
    0.998. Each text is first compared, from end to end, with the first text of each of its keys. A window is done when a
    passage found covers its place, as the window stands for the passages that hold this place. Each window left over
    is then held against every earlier window of its key: the two windows' intervals, aligned at their places and at most
    `least` shingles wide to either side, must hold passages alike around the place, and the two texts are compared from
    end to end. Keys in more than BLOCK windows are dealt into blocks, each pair of which meets once, so that no task holds
    a key; nothing is left untried, and what is found for two texts doesn't depend on how many others there are. So no text keeps a passage of min_words that shares a window's place with an
    earlier one.

    Null ids and texts of fewer words take no part. Texts with equal words are compared once; those of larger ids are
    repeats from end to end. An id may come with several texts: each has its own rows, told apart by text_hash; a
    repeated row counts once. Further columns of docs play no part; an empty table gives an empty result.
    """
    least = max(1, min_words - words + 1)
    signed = written(_scanned(docs, words, hashes, min_words, id_col, text_col), "windows")
    own = written(signed.select("_id", "_t", "n", "digest").distinct(), "texts")
    first_of = written(own.groupBy("digest").agg(F.min("_id").alias("rep"), F.count(F.lit(1)).alias("c")).where("c > 1").select("digest", "rep"), "first")
    copies = written(join_skewed(own, first_of, "digest").where("_id <> rep").select("_id", "_t", "n", F.col("rep").alias("source")), "copies")
    once = _numbered(signed.join(send_small(copies.select("_id", "_t")), ["_id", "_t"], "left_anti"))
    units = written(once.select("_u", "_id", "_t"), "units")
    flat = once.select("_u", F.explode(F.arrays_zip("keys", "ats")).alias("w")).select("_u", F.col("w.keys").alias("key"), F.col("w.ats").alias("at"))
    keys = flat.groupBy("key").agg(F.min("_u").alias("a"), F.max("_u").alias("z"), F.count(F.lit(1)).alias("c")).where("a <> z")
    keys = written(keys.select("key", "a", "c"), "keys")
    tidy(docs)
    place, reach, right = F.shiftright("at", 32).cast("int"), F.shiftright("at", 16).bitwiseAND(F.lit(65535)).cast("int"), F.col("at").bitwiseAND(F.lit(65535)).cast("int")
    shared = flat.join(keys, "key").join(once.select("_u", "fewest", "prints"), "_u")
    both = F.count(F.lit(1)).over(Window.partitionBy("_u", "a"))  # the rows are dealt by _u already
    shared = written(shared.select("key", "_u", "at", "a", "c", both.alias("both"), "fewest", F.substring("prints", place - reach + 1, reach + right + 1).alias("near")), "shared")
    discard(keys)
    likely = _likely(shared, least, percent)
    tidy(docs)
    found = _verified(likely, units, docs, words, percent, min_words, id_col, text_col)

    # windows whose places no passage covers, and all windows of their keys where there is more than the first to compare with
    spans = written(found.groupBy("_u").agg(F.collect_list(F.struct("first", "last")).alias("spans")), "spans")
    marked = shared.join(send_small(spans), "_u", "left")
    covered = F.exists(F.coalesce("spans", F.array()), lambda s: (s["first"] <= place) & (place <= s["last"] - words))
    marked = written(marked.select("key", "_u", "at", "c", ((F.col("_u") != F.col("a")) & ~covered).alias("open")), "marked")
    tidy(docs)
    left = written(marked.where("open AND c > 2").select("key").distinct(), "left")
    own = once.select("_u", F.col("wide").alias("prints"))
    near = marked.join(send_small(left), "key", "left_semi").join(own, "_u").select(
        "key", "_u", place.alias("place"), reach.alias("left"), "open", F.substring("prints", 2 * (place - reach) + 1, 2 * (reach + right + 1)).alias("prints")
    )
    near = written(near, "near")
    discard(signed, shared, marked, left)
    more = _compared(near, words, percent, min_words)
    again = _verified(more, units, docs, words, percent, min_words, id_col, text_col)
    discard(near, more, likely)

    of = lambda x: units.select(F.col("_u").alias(x), F.col("_id").alias(f"_id_{x}"), F.col("_t").alias(f"_t_{x}"))
    named = found.unionByName(again).join(of("_u"), "_u").join(of("a"), "a")
    named = named.select(F.col("_id__u").alias("_id"), F.col("_t__u").alias("_t"), "first", "last", F.col("_id_a").alias("source"))
    whole = copies.select("_id", "_t", F.lit(0).alias("first"), F.col("n").alias("last"), "source")
    out = _merged(whole.unionByName(named))
    return out.select(
        F.col("_id").alias(id_col), F.col("first").alias("start_word"), F.col("last").alias("end_word"), F.col("source").alias("source_id"), F.col("_t").alias("text_hash")
    )


def _likely(shared: DataFrame, least: int, percent: int) -> DataFrame:
    """The pairs (a, _u), with no seeds, that have SURE windows in common, or in which a window of _u has a stretch of `least`
    shingles of which `percent` of `fewest` or more seem to be in the window of the same key that its first text a has,
    told by 8 bits of each. No other pair of windows holds passages alike."""
    later = shared.where("_u <> a")
    first = shared.where("_u = a").select("key", F.col("near").alias("a_near"))
    both = later.where(F.col("both") < SURE).join(first, "key").select("a", "_u", "fewest", "near", "a_near")

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                table = np.zeros((part.num_rows, 256), dtype=bool)
                rows, values, _ = _flat_bytes(part.column(4))
                table[rows, values] = True
                rows, values, place = _flat_bytes(part.column(3))
                hits = np.zeros((part.num_rows, 2 * least), dtype=np.int32)
                hits[rows, place + 1] = table[rows, values]
                hits = hits.cumsum(axis=1, dtype=np.int32)
                enough = 100 * (hits[:, least:] - hits[:, :-least]).max(axis=1) >= percent * part.column(2).to_numpy()
                yield part.select([0, 1]).filter(pa.array(enough))

    likely = both.mapInArrow(releasing(run), "a long, _u long").unionByName(later.where(F.col("both") >= SURE).select("a", "_u"))
    likely = likely.distinct().withColumn("seeds", F.array().cast("array<struct<a:int,b:int>>"))
    return written(likely, "likely")


def _flat_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, value and place in its row of every byte of a column of binaries."""
    column = column.cast(pa.large_binary())
    _, at, raw = column.buffers()
    at = np.frombuffer(at, np.int64)[column.offset : column.offset + len(column) + 1]
    n = np.diff(at)
    rows = np.repeat(np.arange(len(n)), n)
    return rows, np.frombuffer(raw, np.uint8)[at[0] : at[-1]], np.arange(at[-1] - at[0]) - (at[:-1] - at[0])[rows]


def _verified(pairs: DataFrame, units: DataFrame, docs: DataFrame, words: int, percent: int, min_words: int, id_col: str, text_col: str) -> DataFrame:
    """pairs (a, _u, seeds) compared from end to end on 64-bit values of their words: _u, a, first, last (words, exclusive).
    Around a seed (two places) that no passage covers, the stretches of `least` shingles to either side are compared by
    themselves."""
    least = max(1, min_words - words + 1)
    both = written(pairs.select("_u").union(pairs.select("a")).distinct(), "both")
    wanted = written(units.join(send_small(both), "_u").select("_id", "_t", "_u"), "wanted")
    rows = docs.select(F.col(id_col).alias("_id"), text_or_empty(text_col).alias("text"))

    def own(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                every, starts = words_of_texts(part.column(2))
                same = [text_hash(every[a:b]) == t for a, b, t in zip(starts[:-1].tolist(), starts[1:].tolist(), part.column(1).to_pylist())]
                yield part.select([0, 2]).filter(pa.array(same, pa.bool_()))

    texts = rows.join(send_small(wanted), "_id").select("_u", "_t", "text").mapInArrow(releasing(own), "_u long, text string")
    texts = written(texts.dropDuplicates(["_u"]), "texts")
    both = pairs.join(texts, "_u").join(texts.select(F.col("_u").alias("a"), F.col("text").alias("a_text")), "a").select("_u", "a", "seeds", "text", "a_text")

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part, rows = batch.slice(at, SLICE), []
                (y, to), (x, from_) = (shingles_of_texts(*words_of_texts(part.column(c)), words) for c in (3, 4))
                for i, (b, a, seeds) in enumerate(zip(*(part.column(c).to_pylist() for c in range(3)))):
                    spans = spans_of(x[from_[i] : from_[i + 1]], y[to[i] : to[i + 1]], [(s["a"], s["b"]) for s in seeds])
                    rows += [(b, a, f, u + words) for f, u in spans]
                columns = list(zip(*rows)) if rows else [[]] * 4
                types = [pa.int64(), pa.int64(), pa.int32(), pa.int32()]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types)], names=["_u", "a", "first", "last"])

    def spans_of(x, y, seeds):
        spans = [s[2:] for s in shared_passages(x, y, words, percent, min_words)]
        for p, q in seeds:
            if not any(f <= q <= u for f, u in spans):
                at, from_ = max(0, q - least + 1), max(0, p - least + 1)
                spans += [(f + at, u + at) for _, _, f, u in shared_passages(x[from_ : p + least], y[at : q + least], words, percent, min_words)]
        return spans

    found = written(both.mapInArrow(releasing(run), "_u long, a long, first int, last int"), "passages")
    discard(texts)
    return found


def _compared(near: DataFrame, words: int, percent: int, min_words: int) -> DataFrame:
    """For the open windows of near (key, _u, place, left, open, prints), the pairs of texts with the seeds of _earliest_alike.
    Keys of any number of windows are held against themselves as a whole, in blocks: no window is left out or thinned."""
    names = ["key", "_u", "place", "left", "open", "prints"]
    rows = near.select(names)
    sizes = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("_u").alias("lo"), F.max("_u").alias("hi"), F.max("open").alias("some")).where("lo <> hi AND some")
    sizes = written(sizes.select("key", F.ceil(F.col("n") / BLOCK).cast("int").alias("parts")), "sizes")
    rows = rows.join(send_small(sizes), "key")
    rows = rows.withColumn("own", F.pmod(F.xxhash64("_u", "place"), "parts").cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    rows = rows.withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")}).drop("other", "parts")
    dealt = rows.select("i", "j", "own", *names).repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")

    def run(batches):
        at, held = None, None

        def done():
            found = _earliest_alike(held, words, percent, min_words) if held else []
            columns = list(zip(*found)) if found else [[]] * 5
            types = [pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int32()]
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types)], names=["less", "a", "pa", "_u", "pb"])

        for batch in batches:
            block = np.stack([batch.column(x).to_numpy() for x in (3, 0, 1)], axis=1)
            cuts = [0, *(np.flatnonzero((block[1:] != block[:-1]).any(axis=1)) + 1).tolist(), len(block)]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                if tuple(block[a]) != at:
                    yield done()
                    at, held = tuple(block[a]), {n: [] for n in ("part", *names)}
                part = batch.slice(a, b - a)
                held["part"] += part.column(2).to_pylist() if block[a][1] != block[a][2] else range(-len(held["part"]) - b + a, -len(held["part"]))
                for x, n in enumerate(names):
                    held[n] += part.column(x + 3).to_pylist()
        yield done()

    pairs = dealt.mapInArrow(releasing(run), "less int, a long, pa int, _u long, pb int")
    one = pairs.groupBy("_u", "pb").agg(F.min(F.struct("less", "a", "pa")).alias("m"))  # the one with most in common
    out = one.groupBy(F.col("m.a").alias("a"), "_u").agg(F.collect_list(F.struct(F.col("m.pa").alias("a"), F.col("pb").alias("b"))).alias("seeds"))
    return written(out, "alike")


def _merged(spans: DataFrame) -> DataFrame:
    """Spans (_id, _t, first, last, source) of each text, those that overlap as one, with the smallest source."""
    order = Window.partitionBy("_id", "_t").orderBy("first", "last")
    reach = F.max("last").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = spans.withColumn("_new", F.coalesce((F.col("first") >= reach).cast("int"), F.lit(1)))
    marked = marked.withColumn("_g", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy("_id", "_t", "_g").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.min("source").alias("source")).drop("_g")


def cut_passages(docs: DataFrame, spans: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the words of their spans (id_col, start_word, end_word, text_hash); white space before them goes too.

    A span is cut only from the text it was found in: rows of one id with other texts stay whole, rows alike are cut
    alike. Rows with null ids or null texts stay as they are; further columns are kept; empty tables give an empty result.
    """
    lists = spans.groupBy(F.col(id_col).alias("_sid")).agg(F.sort_array(F.collect_list(F.struct("text_hash", "start_word", "end_word"))).alias("_spans"))
    lists = written(lists, "cuts")
    names = docs.columns
    joined = docs.join(send_small(lists), docs[id_col] == lists["_sid"], "left").select(*[docs[c] for c in names], "_spans")
    place = names.index(text_col)

    def run(batches):
        for batch in batches:
            out = []
            for text, cuts in zip(batch.column(place).to_pylist(), batch.column(len(names)).to_pylist()):
                if text and cuts:
                    own = text_hash(word_values(text))
                    ends = [(m.start(), m.end()) for m in _WORD.finditer(text)]
                    kept, at = [], 0
                    for cut in (c for c in cuts if c["text_hash"] == own):
                        first, last = cut["start_word"], min(cut["end_word"], len(ends))
                        if first < last:
                            kept.append(text[at : ends[first - 1][1] if first else 0])
                            at = ends[last - 1][1]
                    text = "".join([*kept, text[at:]])
                out.append(text)
            columns = batch.columns[: len(names)]
            columns[place] = pa.array(out, batch.schema.field(place).type)
            yield pa.RecordBatch.from_arrays(columns, schema=pa.schema([batch.schema.field(i) for i in range(len(names))]))

    return joined.mapInArrow(releasing(run), docs.schema)


def op2_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return substring_duplicates(read_documents(spark, sf_dir))
