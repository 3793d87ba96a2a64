"""MinHash near-duplicates with min-max hashing, confirmed on full shingle sets.

Each permutation of the shingles' hashes gives two values of the signature, its minimum and its maximum,
so that PERMUTATIONS evaluations make twice as many values. Bands of ROWS values (all minima or all maxima,
of different permutations) propose candidates: with the defaults a pair of similarity 0.85 meets in no band
with a probability below 1e-6, one of 0.8 below 1.2e-4; near_duplicates() takes a similarity and picks the
number of bands for a probability below MISS at that similarity.

1. Texts with the same set are one class, known by a number of its own. Only classes go on, with one of their texts.
2. In each bucket of a band, every class is compared with the bucket's first class, on full sets (star): the one that
   meets most others in its buckets, as the text that others were made from does.
3. Components of the links so far. In buckets that hold several components, pairs of classes of different
   components are left. In buckets of up to SMALL classes those pairs are compared that the metric does not rule
   out: Jaccard distance obeys the triangle inequality, so that two classes whose known distances from the
   bucket's first class differ by more than the threshold allows are not linked. The classes of larger buckets
   are joined by an exact set-similarity join (prefix, length and positional filters on shingles ordered by
   rarity, as in line_dedup.py) that makes only pairs of different components. Then the components are made again.

So every pair that shares a bucket is compared, unless it is in one component already or the filters prove
that it is not similar enough: no link that changes a component is lost to the size of a bucket. Nothing is
capped, and pairs within a group of linked copies are not made. Bucket sums combine on the map side; copies of
a text make one class; hot buckets are split by adaptive execution in joins, and classes are compared after a
join on the pair, so that a hot class spreads over tasks.

Sets are compared as sorted 64-bit hashes of the shingles. Edge cases: texts without words (null and empty
ones) have an empty set and are linked with nothing; texts with fewer words than a shingle have one shingle.
Texts are read whole. Every row is a document of its own, whatever its id: rows that repeat an id with different
texts are compared each with its own text, and rows without an id link others as any row does. A component's id
is the smallest id in it, null if none of its rows has one. annotate() marks as kept every row with that id;
representatives() leaves one row of each component. Other input columns, whatever their names, are ignored by
annotate() and kept by representatives(). An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _common as C
from .components import components
from .line_dedup import BUCKETS, level_array, matches

ROWS, MISS, SEED = 5, 1e-6, 0x5EED
WORDS_KEPT = 400_000
SMALL = 64  # classes of a bucket up to which its open pairs are compared one by one

class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORDS_KEPT:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_words = _Words()


def bands_for(similarity: float, rows: int = ROWS, miss: float = MISS) -> int:
    """Bands needed so that a pair of that similarity meets in none with a probability below miss; even."""
    n = math.ceil(math.log(miss) / math.log(1 - similarity**rows))
    return n + n % 2


def shingles(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of a text."""
    words = (text or "").encode("utf-8").lower().split()
    h = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    n = min(size, len(h))
    if not n:
        return h
    with np.errstate(over="ignore"):
        s = np.full(len(h) - n + 1, n, np.uint64)
        for i in range(n):
            s = (s ^ h[i : len(h) - n + 1 + i]) * np.uint64(0x9FB21C651E98DF25)
            s ^= s >> np.uint64(32)
    return np.unique(s)


def permutations(count: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(SEED)
    draw = lambda: rng.integers(1, 2**63, count, dtype=np.int64).astype(np.uint64)
    return draw() * np.uint64(2) + np.uint64(1), draw()


def signature_bands(s: np.ndarray, a: np.ndarray, b: np.ndarray, rows: int) -> np.ndarray:
    """One 64-bit key for each band: first those of minima, then those of maxima."""
    low = np.full(len(a), np.iinfo(np.uint64).max, np.uint64)
    high = np.zeros(len(a), np.uint64)
    with np.errstate(over="ignore"):
        for i in range(0, len(s), 2048):
            x = s[None, i : i + 2048] * a[:, None] + b[:, None]
            x ^= x >> np.uint64(29)
            x *= np.uint64(0xBF58476D1CE4E5B9)
            np.minimum(low, x.min(axis=1), out=low)
            np.maximum(high, x.max(axis=1), out=high)
        values = np.concatenate([low, high]).reshape(-1, rows)
        key = np.arange(len(values), dtype=np.uint64)
        for i in range(rows):
            key = (key ^ values[:, i]) * np.uint64(0x9FB21C651E98DF25)
            key ^= key >> np.uint64(31)
    return key


def _sets(size: int, bands: int, rows: int):
    def run(batches):
        a, b = permutations(bands * rows // 2)
        for batch in batches:
            n, key, band = [], [], []
            for text in batch.column(1).to_pylist():
                s = shingles(text, size)
                n.append(len(s))
                key.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                band.append(signature_bands(s, a, b, rows).astype(np.int64) if len(s) else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n, pa.int64()), pa.array(key, pa.binary()), pa.array(band, pa.list_(pa.int64()))], ["doc_id", "h", "n", "set_key", "bands"])

    return run


def _compare(size: int):
    """Rows u, v, u_text, v_text to u, v, common, united; the sets of the last texts are kept."""

    def run(batches):
        kept: dict[int, np.ndarray] = {}

        def of(i, text):
            if i not in kept:
                if len(kept) >= 64:
                    kept.clear()
                kept[i] = shingles(text, size)
            return kept[i]

        for batch in batches:
            common, united = [], []
            for u, v, x, y in zip(*(batch.column(i).to_pylist() for i in range(4))):
                s, t = of(u, x), of(v, y)
                both = np.concatenate([s, t])
                both.sort(kind="stable")
                same = int((both[1:] == both[:-1]).sum())
                common.append(same)
                united.append(len(both) - same)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(common, pa.int64()), pa.array(united, pa.int64())], ["u", "v", "common", "united"])

    return run


def _tokens(size: int):
    def run(batches):
        for batch in batches:
            sets = [shingles(x, size).astype(np.int64) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sets, pa.list_(pa.int64()))], ["id", "component", "tokens"])

    return run


def _bucket_counts(batches):
    """How often each hash bucket of shingles occurs in a partition: a row a bucket, whatever the partition holds."""
    n = np.zeros(BUCKETS, np.int64)
    for batch in batches:
        n += np.bincount(batch.column(0).flatten().to_numpy() % BUCKETS, minlength=BUCKETS)
    at = np.flatnonzero(n)
    if len(at):
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(n[at], pa.int64())], ["b", "n"])


def compared(pairs: DataFrame, texts: DataFrame, size: int) -> DataFrame:
    """Sizes of intersection and union for pairs (u, v); texts: node, text."""
    side = lambda name: texts.select(F.col("node").alias(name), F.col("text").alias(f"{name}_text"))
    rows = pairs.join(side("v"), "v").join(side("u"), "u").select("u", "v", "u_text", "v_text")
    return rows.mapInArrow(_compare(size), "u long, v long, common long, united long")


def _classed(docs: DataFrame, size: int, percent: int, rows: int, miss: float) -> tuple[DataFrame, DataFrame]:
    """docs: doc_id, text. Two tables: the rows (doc_id, h: a hash of the text, n, set_key) and the classes of rows with
    words (set_key, least: the smallest (no id, id, h) of the class, component)."""
    C.prepare(docs.sparkSession)
    bands = bands_for(percent / 100, rows, miss)
    docs = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text")).withColumn("h", F.xxhash64("text"))
    sets = C.materialise(docs.select("doc_id", "text", "h").mapInArrow(_sets(size, bands, rows), "doc_id long, h long, n long, set_key binary, bands array<long>"), "sets")
    least = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id"), F.col("h"))
    classes = sets.where("n > 0").groupBy("set_key").agg(F.min(least).alias("least"), F.max("n").alias("n"), F.first("bands").alias("bands"))
    classes = C.materialise(classes.withColumn("node", F.monotonically_increasing_id()), "classes")

    buckets = classes.select("node", F.explode("bands").alias("band"))
    sizes = buckets.groupBy("band").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    shared = C.materialise(buckets.join(sizes, "band"), "shared")
    met = shared.groupBy("node").agg(F.sum("members").alias("met"))
    centres = shared.join(met, "node").groupBy("band").agg(F.max(F.struct("met", "node"))["node"].alias("first"))
    members = C.materialise(shared.join(centres, "band").select("band", "first", "node"), "members")
    star = members.where("node <> first").select(F.col("first").alias("u"), F.col("node").alias("v")).distinct()
    nodes = classes.join(members.select("node").distinct(), "node", "left_semi").select("node", F.col("least.doc_id").alias("id"), F.col("least.h").alias("hash"))
    texts = docs.join(nodes, docs["doc_id"].eqNullSafe(nodes["id"]) & (docs["h"] == nodes["hash"])).groupBy("node").agg(F.first("text").alias("text"))
    texts = C.materialise(texts, "texts")
    known = C.materialise(compared(star, texts, size), "compared")
    links = known.where(f"100 * common >= {percent} * united").select("u", "v")
    label = components(links)

    # what is left: pairs of a bucket that lie in different components
    at = members.join(label, "node", "left").withColumn("component", F.coalesce("component", "node"))
    far = known.select(F.col("u").alias("first"), F.col("v").alias("node"), (1 - F.col("common") / F.col("united")).alias("far"))
    at = at.join(far, ["first", "node"], "left").select("band", "node", "component", F.coalesce("far", F.lit(0.0)).alias("far"))
    mixed = at.groupBy("band").agg(F.min("component").alias("a"), F.max("component").alias("b"), F.count(F.lit(1)).alias("k")).where("a < b")
    at = C.materialise(at.join(mixed.select("band", "k"), "band"), "mixed")
    x, y = at.where(F.col("k") <= SMALL).alias("x"), at.where(F.col("k") <= SMALL).alias("y")
    apart = (F.col("x.node") < F.col("y.node")) & (F.col("x.component") != F.col("y.component")) & (F.abs(F.col("x.far") - F.col("y.far")) <= 1 - percent / 100 + 1e-9)
    pairs = x.join(y, (F.col("x.band") == F.col("y.band")) & apart).select(F.col("x.node").alias("u"), F.col("y.node").alias("v")).distinct()
    small = compared(pairs, texts, size).where(f"100 * common >= {percent} * united").select("u", "v")
    in_large = at.where(F.col("k") > SMALL).select("node", "component").distinct()
    rest = texts.join(in_large, "node").select("node", "component", "text").mapInArrow(_tokens(size), "id long, component long, tokens array<long>")
    rest = C.materialise(rest, "rest")
    counts = rest.select("tokens").mapInArrow(_bucket_counts, "b int, n long").groupBy("b").agg(F.sum("n").alias("n"))
    large = matches(rest, level_array(counts), percent, "component").select(F.col("a").alias("u"), F.col("b").alias("v"))
    more = C.materialise(small.union(large), "more")
    if more.take(1):
        label = components(links.union(more))
    of_class = classes.join(label, "node", "left").select("set_key", "least", F.coalesce("component", "node").alias("component"))
    C.release(shared, members, texts, known, at, rest)
    return sets.select("doc_id", "h", "n", "set_key"), C.materialise(of_class, "labelled")


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, rows: int = ROWS, miss: float = MISS) -> DataFrame:
    """docs: doc_id, text. Returns doc_id, n_shingles, component_id; linked are texts with 100 * common >= percent * united."""
    sets, classes = _classed(docs, size, percent, rows, miss)
    top = classes.groupBy("component").agg(F.min("least.doc_id").alias("top"))
    of_class = classes.join(top, "component").select("set_key", "top")
    alone = F.when(F.col("set_key").isNull(), F.col("doc_id"))  # rows without words
    return sets.join(of_class, "set_key", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("top", alone).alias("component_id"))


def annotate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row."""
    rows = near_duplicates(docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text")), size, percent)
    return rows.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def representatives(docs: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, with all columns: one row of each component (its smallest id), and every row without words."""
    sets, classes = _classed(docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text")), size, percent, ROWS, MISS)
    least = classes.groupBy("component").agg(F.min("least").alias("least")).select(F.col("least.doc_id").alias("id"), F.col("least.h").alias("hash"))
    keep = C.materialise(least.join(sets.groupBy("doc_id", "h").agg(F.count(F.lit(1)).alias("times")), F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("hash") == F.col("h"))).select("id", "hash", "times"), "keep")
    mark = C.fresh("hash_of_text", [*docs.columns, "id", "hash"])
    rows, wordless = docs.withColumn(mark, F.xxhash64(docs[text_col])), ~F.coalesce(docs[text_col], F.lit("")).rlike("[^\\x20\\x09-\\x0D]")
    id_of = lambda df: df[id_col].cast("long")
    kept = rows.join(keep, id_of(rows).eqNullSafe(keep["id"]) & (rows[mark] == keep["hash"]), "left_semi")
    if keep.where("times > 1").take(1):  # rows repeat an id and a text
        kept = kept.dropDuplicates([id_col, mark])
    return kept.select(*[kept[c] for c in docs.columns]).union(docs.where(wordless))


def op2_near_dedup(spark, sf_dir: str) -> DataFrame:
    return annotate(C.table(spark, sf_dir, "documents"), size=3, percent=85)
