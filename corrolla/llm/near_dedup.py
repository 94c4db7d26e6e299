"""Near-duplicates by set sketches: registers of truncated minima, banded, jointly estimated, then verified on the sets."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from corrolla.llm.common import join_skewed, read_documents, releasing, send_small, text_or_empty, written
from corrolla.llm.components import components
from corrolla.llm.shingles import mix, set_digest, shingles_of_texts, words_of_texts

#: Documents that a worker sketches at a time.
SLICE = 128
#: Classes, and shingles of all of them, that one side of a block holds.
BLOCK_CLASSES, BLOCK_SHINGLES = 128, 400_000


@dataclass(frozen=True)
class Sketch:
    """bands x rows registers. A register is floor(1 - log_base h) of the least h of the set's elements, kept within
    0 and top, where h is exponential with the given rate: sketches of a union are the registers' maxima, and two
    registers agree with a probability close to the sets' Jaccard similarity, as base is close to 1."""

    bands: int = 42
    rows: int = 6
    base: float = 1.001
    rate: float = 20.0
    top: int = (1 << 16) - 1

    @property
    def size(self) -> int:
        return self.bands * self.rows

    def minima(self, sets: list[np.ndarray]) -> np.ndarray:
        """(sets, size): each register's least h. An element's values arrive in ascending order, each for a random
        register, and it stops once the next is above all the registers of its set."""
        m, k = self.size, len(sets)
        out = np.full(k * m, np.inf)
        owner = np.repeat(np.arange(k), [len(s) for s in sets])
        seed = np.concatenate([np.asarray(s, dtype=np.uint64) for s in sets]) if k else np.zeros(0, np.uint64)
        at, step = np.zeros(len(seed)), 0
        while len(seed):
            step += 1
            random = mix(seed + np.uint64(step * 0xD1342543DE82EF95 & (1 << 64) - 1))
            at = at - np.log(((random >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / (self.rate * m)
            place = mix(random) % np.uint64(m)
            np.minimum.at(out, owner * m + place.astype(np.int64), at)
            if step == 1 or step % 2 == 0:
                worst = out.reshape(k, m).max(axis=1)
            go = at < worst[owner]
            if not go.all():
                seed, owner, at = seed[go], owner[go], at[go]
        return out.reshape(k, m)

    def registers(self, sets: list[np.ndarray]) -> np.ndarray:
        h = self.minima(sets)
        with np.errstate(divide="ignore"):
            k = np.floor(1 - np.log(h) / np.log(self.base))
        return np.clip(k, 0, self.top).astype(np.uint16)

    def estimate(self, a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
        """The most likely Jaccard similarity of each pair of sketches, from how many registers are larger, smaller
        and equal, with the sets' sizes known."""
        up, down = (a > b).sum(axis=1), (a < b).sum(axis=1)
        same = self.size - up - down
        u = na / (na + nb)
        v = 1 - u
        p = lambda x: np.clip(-np.log1p(-np.clip(x, 1e-12, 1) * (self.base - 1) / self.base) / np.log(self.base), 1e-12, 1)
        lo, hi = np.zeros(len(u)), np.minimum(u / v, v / u)

        def like(j):
            more, less = p(u - v * j), p(v - u * j)
            return up * np.log(more) + down * np.log(less) + same * np.log(np.clip(1 - more - less, 1e-12, 1))

        for _ in range(30):  # the likelihood has one peak
            x, y = lo + (hi - lo) / 3, hi - (hi - lo) / 3
            left = like(x) > like(y)
            lo, hi = np.where(left, lo, x), np.where(left, y, hi)
        return (lo + hi) / 2


def shingle_sets(texts: pa.Array, words: int) -> list[np.ndarray]:
    """The set of shingles of each text (no nulls), in order."""
    values, starts = shingles_of_texts(*words_of_texts(texts), words)
    return [np.unique(values[a:b]) for a, b in zip(starts[:-1].tolist(), starts[1:].tolist())]


def sketch_documents(docs: DataFrame, sketch: Sketch, words: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """_id, n (size of the shingle set), digest (of the set; null if empty), registers (binary; null if empty)."""
    rows = docs.select(F.col(id_col).alias("_id"), text_or_empty(text_col).alias("_text"))
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                sets = shingle_sets(part.column(1), words)
                full = [i for i, s in enumerate(sets) if len(s)]
                registers: list = [None] * len(sets)
                for i, r in zip(full, sketch.registers([sets[i] for i in full])):
                    registers[i] = r.tobytes()
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([set_digest(s) if len(s) else None for s in sets], pa.binary()),
                        pa.array(registers, pa.binary()),
                    ],
                    names=["_id", "n", "digest", "registers"],
                )

    return rows.mapInArrow(releasing(run), f"_id {kind}, n long, digest binary, registers binary")


def _sets_of(wanted: DataFrame, docs: DataFrame, words: int, id_col: str, text_col: str) -> DataFrame:
    """wanted (node, _id, n) with each node's whole set (binary), recomputed from a document that has it."""
    rows = docs.select(F.col(id_col).alias("_id"), text_or_empty(text_col).alias("_text"))
    found = rows.join(send_small(wanted), "_id")

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                sets = shingle_sets(part.column(0), words)
                own = [set_digest(s) == d for s, d in zip(sets, part.column(1).to_pylist())]  # an id may come with several texts
                kept = part.select([1, 2]).filter(pa.array(own, pa.bool_()))
                yield pa.RecordBatch.from_arrays([*kept.columns, pa.array([s.tobytes() for s, ok in zip(sets, own) if ok], pa.binary())], names=["node", "n", "values"])

    return found.select("_text", "node", "n").mapInArrow(releasing(run), "node binary, n long, values binary")


def _block_links(pdf: pd.DataFrame, percent: int) -> pd.DataFrame:
    """Links that connect what is alike between the two sides of one block, a tree's worth at most: the classes' shingles
    are counted in common by products of membership matrices, some thousand shingles at a time. Side 0 is compared with
    itself and with side 1."""
    pdf = pdf.sort_values(["side", "node"], ignore_index=True)
    sets = [np.frombuffer(x, np.uint64) for x in pdf["values"]]
    own, left = np.array([len(x) for x in sets]), int((pdf["side"] == 0).sum())
    flat, row = np.concatenate(sets), np.repeat(np.arange(len(sets)), own)
    order = np.argsort(flat, kind="stable")
    flat, row = flat[order], row[order]
    start = np.flatnonzero(np.r_[True, flat[1:] != flat[:-1]])
    width = np.diff(np.r_[start, len(flat)])
    shared = np.repeat(width > 1, width)
    column = (np.cumsum(np.r_[0, (width > 1)])[:-1]).repeat(width)[shared]
    row = row[shared]
    both = np.zeros((left, len(sets)), dtype=np.float32)
    step = 4096
    cuts = np.searchsorted(column, np.arange(0, (column[-1] if len(column) else 0) + step, step))
    for a, b in zip(cuts, np.r_[cuts[1:], len(column)]):
        if a < b:
            m = np.zeros((len(sets), step), dtype=np.float32)
            m[row[a:b], column[a:b] % step] = 1
            both += m[:left] @ m.T
    both = both.astype(np.int64)
    alike = 100 * both >= percent * (own[:left, None] + own[None, :] - both)
    parent = list(range(len(sets)))

    def root(x):
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    links = []
    for i, j in zip(*np.nonzero(np.triu(alike, 1))):
        a, b = root(int(i)), root(int(j))
        if a != b:
            parent[max(a, b)] = min(a, b)
            links.append((pdf["node"][int(i)], pdf["node"][int(j)]))
    return pd.DataFrame(links, columns=["a", "b"])


def _unlikely_pairs(groups: DataFrame, classes: DataFrame, sketch: Sketch, percent: int, margin: float) -> DataFrame:
    """Labels of groups of two whose sketches put them more than margin, many standard errors, below the threshold:
    their texts need not be fetched."""
    two = groups.groupBy("label").agg(F.count(F.lit(1)).alias("g"), F.min("node").alias("a"), F.max("node").alias("b")).where("g = 2")
    two = written(two, "two")
    ends = two.select("label", F.col("a").alias("node"), F.lit(True).alias("first")).unionByName(two.select("label", F.col("b").alias("node"), F.lit(False).alias("first")))
    own = classes.join(send_small(written(ends, "ends")), "node")
    one = lambda x, c: F.max(F.when(F.col("first") == x, F.col(c))).alias(f"{c}_{x}")
    rows = own.groupBy("label").agg(one(True, "n"), one(False, "n"), one(True, "registers"), one(False, "registers"))

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                a, b = (np.stack([np.frombuffer(x, np.uint16) for x in batch.column(i).to_pylist()]) for i in (3, 4))
                na, nb = (batch.column(i).to_numpy().astype(float) for i in (1, 2))
                low = sketch.estimate(a, b, na, nb) < percent / 100 - margin
                yield batch.select([0]).filter(pa.array(low))

    return rows.mapInArrow(releasing(run), "label long")


def _parts(rows: DataFrame, key: str) -> DataFrame:
    """key and parts of the groups of rows (key, n) that need more than one side of a block."""
    parts = F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK_CLASSES), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int")
    return written(rows.groupBy(key).agg(parts.alias("parts")).where("parts > 1"), "parts")


def _dealt(rows: DataFrame, parts: DataFrame, key: str, name: str) -> DataFrame:
    """rows with the number of parts of their group, and which they are in (column name)."""
    out = rows.join(send_small(parts), key, "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    return out.withColumn(name, F.pmod(F.xxhash64("node"), "parts").cast("int"))


def _links(sets: DataFrame, groups: DataFrame, percent: int) -> DataFrame:
    """Links that connect all that is alike within each candidate group (label, node), whatever its size.

    A group is dealt into parts that one side of a block holds. First each part is compared with itself and with the
    first one, whose classes so are leaders; a group of one part is done then. In larger ones, classes outside the
    group's largest component are then compared with all classes of the group: links inside a component change nothing.
    So a group costs its size times one part, and its outsiders times its size.
    """
    sized = written(sets.select("node", "n").join(send_small(groups), "node"), "sized")
    parts = _parts(sized, "label")
    dealt = _dealt(sized, parts, "label", "part")
    own = dealt.select("node", "label", "part", F.lit(0).alias("side"))
    # the first part goes to every other one's block
    lead = dealt.where("part = 0 AND parts > 1").select("node", "label", F.explode(F.sequence(F.lit(1), F.col("parts") - 1)).alias("part"), F.lit(1).alias("side"))
    places = written(own.unionByName(lead), "blocks")
    rows = sets.select("node", "values").join(send_small(places), "node")
    block = lambda pdf: _block_links(pdf, percent)
    links = written(rows.groupBy("label", "part").applyInPandas(block, "a binary, b binary"), "links")
    if not parts.take(1):
        return links
    large = written(sized.join(send_small(parts.select("label")), "label"), "large")
    of = components(links).select("node", F.col("label").alias("own"))
    marked = written(large.join(of, "node", "left").withColumn("own", F.coalesce("own", "node")), "marked")
    main = marked.groupBy("label", "own").agg(F.count(F.lit(1)).alias("c")).groupBy("label").agg(F.max(F.struct("c", "own")).alias("m"))
    outside = marked.join(send_small(written(main.select("label", F.col("m.own").alias("main")), "main")), "label").where("own <> main")
    outside = written(outside.select("node", "label", "n"), "outside")
    if not outside.take(1):
        return links
    few = _parts(outside, "label")
    left = _dealt(outside, few, "label", "i").select("node", "label", "i")
    counts = written(left.groupBy("label").agg((F.max("i") + 1).alias("lefts")), "lefts")
    right = _dealt(large, parts, "label", "part").join(send_small(counts), "label")
    right = right.select("node", "label", "part", F.explode(F.sequence(F.lit(0), F.col("lefts") - 1)).alias("i"), F.lit(1).alias("side"))
    left = left.join(send_small(parts), "label").select("node", "label", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "i", F.lit(0).alias("side"))
    places = written(left.unionByName(right), "blocks")
    rows = sets.select("node", "values").join(send_small(places), "node")
    return links.unionByName(rows.groupBy("label", "part", "i").applyInPandas(block, "a binary, b binary"))


def _labelled(docs: DataFrame, words: int, percent: int, sketch: Sketch, id_col: str, text_col: str, margin: float) -> DataFrame:
    """For each row of docs: _id, n (shingles), digest (of the set), label (digest of one set of the component); the last two
    are null without words."""
    signed = written(sketch_documents(docs, sketch, words, id_col, text_col), "sketches")
    classes = signed.where("n > 0").groupBy("digest").agg(F.min("_id").alias("_id"), F.first("n").alias("n"), F.first("registers").alias("registers"))
    classes = written(classes.withColumnRenamed("digest", "node"), "classes")
    width = 2 * sketch.rows
    at = F.sequence(F.lit(0), F.lit(sketch.bands - 1))
    short = F.xxhash64("node")  # stands for the class in the bands; a clash of two adds candidates
    band = classes.select(short.alias("s"), F.explode(F.transform(at, lambda i: F.xxhash64(i, F.expr("registers").substr(i * width + 1, F.lit(width))))).alias("band"))
    lead = band.groupBy("band").agg(F.min("s").alias("a"), F.max("s").alias("z")).where("a <> z").select("band", "a")
    stars = band.join(send_small(written(lead, "lead")), "band").where("s <> a").select("a", F.col("s").alias("b"))
    groups = components(stars).select(F.col("node").alias("s"), "label")
    names = classes.select(short.alias("s"), "node").join(send_small(written(groups, "stars")), "s")
    groups = written(names.select("label", "node"), "groups")
    low = written(_unlikely_pairs(groups, classes, sketch, percent, margin), "unlikely")
    groups = written(groups.join(send_small(low), "label", "left_anti"), "likely")
    wanted = written(classes.select("node", "_id", "n").join(send_small(groups.select("node")), "node"), "wanted")
    sets = written(_sets_of(wanted, docs, words, id_col, text_col).dropDuplicates(["node"]), "sets")
    links = written(_links(sets, groups, percent), "links")
    rows = signed.select("_id", "n", "digest")
    if not links.take(1):
        return rows.withColumn("label", F.col("digest"))
    of = components(links).select(F.col("node").alias("digest"), "label")
    return rows.join(send_small(written(of, "of")), "digest", "left").withColumn("label", F.coalesce("label", "digest"))


def near_duplicates(
    docs: DataFrame,
    words: int = 5,
    percent: int = 80,
    sketch: Sketch = Sketch(),
    id_col: str = "doc_id",
    text_col: str = "text",
    margin: float = 0.2,
) -> DataFrame:
    """For each row of docs: id_col, n_shingles, component_id (the smallest id reachable over links), kept.

    Two documents are linked if 100 * |A & B| >= percent * |A | B| for their sets of `words`-word shingles (one of all
    words if there are fewer). Documents with equal sets form one class and are compared once. Classes that share a
    band of registers are candidates; those that candidates connect make a group; of two, those whose joint estimate is
    more than margin, many standard errors, too low are let go. Within a group links are tested on the whole sets, in
    blocks of bounded size (_links); no pair is a row, and a block gives no more links than it has classes.

    Null or empty texts and texts without words: n_shingles 0, linked with nothing, kept. Rows alike are of one class;
    a repeated id stands for all its texts' classes, each row with its own. A null id has the component of the
    rows with its set, and is compared with others only through them. Further columns of docs play no part. An empty
    table gives an empty result.
    """
    rows = written(_labelled(docs, words, percent, sketch, id_col, text_col, margin), "labelled")
    first = written(rows.where("n > 0").groupBy("label").agg(F.min("_id").alias("component_id")), "smallest")
    full = join_skewed(rows.where("n > 0"), first, "label").select("_id", "n", "component_id")
    empty = rows.where("n = 0").select("_id", "n", F.col("_id").alias("component_id"))
    return full.unionByName(empty).select(
        F.col("_id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", F.col("_id").eqNullSafe(F.col("component_id")).alias("kept")
    )


def drop_near_duplicates(
    docs: DataFrame,
    words: int = 5,
    percent: int = 80,
    sketch: Sketch = Sketch(),
    id_col: str = "doc_id",
    text_col: str = "text",
    margin: float = 0.2,
) -> DataFrame:
    """One row of docs for each group of near-duplicates (see near_duplicates): the one with the smallest id, of several
    texts of that id the one whose set has the smallest digest. Rows without words stay.

    Texts of a repeated id are judged each by itself; of rows with the same id and the same set one stays, also without
    words. A null id comes after all others. All columns are kept; an empty table gives an empty result.
    """
    rows = written(_labelled(docs, words, percent, sketch, id_col, text_col, margin), "labelled")
    place = F.struct(F.col("_id").isNull().alias("none"), "_id", "digest")
    best = written(rows.where("n > 0").groupBy("label").agg(F.min(place).alias("best")), "best")
    gone = join_skewed(rows.where("n > 0").select("label", place.alias("place")), best, "label").where("NOT place <=> best")
    gone = written(gone.select("place._id", "place.digest").distinct(), "gone")
    odd = written(rows.groupBy("_id").agg(F.count(F.lit(1)).alias("c")).where("c > 1 OR _id IS NULL").select(F.col("_id").alias("_odd")), "odd")
    left = docs.join(send_small(gone.select(F.col("_id").alias("_gone"))), docs[id_col] == F.col("_gone"), "left_anti")
    if not odd.take(1):
        return left
    of_odd = docs[id_col].eqNullSafe(F.col("_odd"))
    plain = left.join(send_small(odd), left[id_col].eqNullSafe(F.col("_odd")), "left_anti")
    names, at = docs.columns, docs.columns.index(text_col)

    def digests(batches):
        for batch in batches:
            sets = shingle_sets(batch.column(at).cast(pa.string()).fill_null(""), words)
            own = pa.array([set_digest(s) if len(s) else None for s in sets], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, own], schema=batch.schema.append(pa.field("_set", pa.binary())))

    several = docs.join(send_small(odd), of_odd, "left_semi")
    several = several.mapInArrow(releasing(digests), StructType([*docs.schema.fields, StructField("_set", BinaryType())]))
    several = several.join(gone.withColumnsRenamed({"_id": "_gone", "digest": "_own"}), several[id_col].eqNullSafe(F.col("_gone")) & several["_set"].eqNullSafe(F.col("_own")), "left_anti")
    return plain.unionByName(several.dropDuplicates([id_col, "_set"]).select(names))


def op1_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(read_documents(spark, sf_dir), words=2, percent=80)
