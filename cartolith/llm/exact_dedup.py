"""Exact deduplication with a minimal perfect hash over historical digests.

Texts are equal when they are identical after deletion of every character of [\\x20\\x09-\\x0D]. Of equal
texts the row with the most code points in its original text stays, then the smallest doc_id.

The history is a table of shards. A shard holds a minimal perfect hash over the distinct digests that fall
into it; the slot of a digest holds the full digest and the locator of the row that stays (its length and
doc_id) with the number of copies. Arriving digests are looked up in their shard and compared byte by byte
with the slot: members join the historical group, nonmembers form groups of their own.

Digests are summed up before they are dealt to shards, so that copies make one row each task, and shards
are filled by a hash of the digest: no text, however frequent, makes a large shard. Nothing but digests,
lengths and ids is shuffled.

Edge cases: a null text counts as the empty text, and all those are one group. A null doc_id loses every
tie and gives a null keep_id only if no row of the group has an id; the id 2^63 - 1 counts as null. Rows repeated with their doc_id are
copies of each other; all rows with the doc_id and length that stay are marked as kept, and
drop_duplicates() leaves one of them. Other columns of the input, whatever their names, are ignored by
annotate() and kept by drop_duplicates(). An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import _common as C
from .mph import MinimalPerfectHash, as_matrix

PER_SHARD = 50_000
NO_ID = 2**63 - 1

INDEX = "shard int, n long, mph binary, digests binary, lengths binary, ids binary, copies binary"
GROUPS = "digest binary, n_cp long, keep long, copies long, member boolean"


def normalised(text):
    return F.regexp_replace(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]++", "")


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, digest, n_cp of every row."""
    return docs.select(
        docs[id_col].cast("long").alias("doc_id"),
        F.unhex(F.sha2(normalised(docs[text_col]), 256)).alias("digest"),
        F.length(F.coalesce(docs[text_col], F.lit(""))).cast("long").alias("n_cp"),
    )


def summed(rows: DataFrame) -> DataFrame:
    """One row for each digest: the row that stays and the number of copies. Combines on the map side."""
    best = F.min(F.struct((-F.col("n_cp")).alias("l"), F.coalesce("doc_id", F.lit(NO_ID)).alias("i")))
    return rows.groupBy("digest").agg(best.alias("b"), F.count(F.lit(1)).alias("copies")).select(
        "digest", (-F.col("b.l")).alias("n_cp"), F.col("b.i").alias("keep"), "copies"
    )


def _shard(shards: int):
    return F.pmod(F.conv(F.hex(F.substring("digest", 25, 7)), 16, 10).cast("long"), F.lit(shards)).cast("int")


def _build(pdf: pd.DataFrame) -> pd.DataFrame:
    keys = as_matrix(pdf.digest)
    mph = MinimalPerfectHash.build(keys)
    slot = mph.slots(keys)
    if (slot < 0).any() or len(np.unique(slot)) != len(slot):
        raise ValueError("two digests of a shard share their first 128 bits")
    order = np.argsort(slot)
    take = lambda name: pdf[name].to_numpy(np.int64)[order].tobytes()
    return pd.DataFrame([{
        "shard": int(pdf["shard"].iloc[0]), "n": len(pdf), "mph": mph.to_bytes(), "digests": keys[order].tobytes(),
        "lengths": take("n_cp"), "ids": take("keep"), "copies": take("copies"),
    }])


def build_history(groups: DataFrame, shards: int) -> DataFrame:
    """The index over distinct digests (as summed() gives them), one row a shard."""
    return groups.withColumn("shard", _shard(shards)).groupBy("shard").applyInPandas(_build, INDEX)


def _lookup(arriving: pd.DataFrame, index: pd.DataFrame) -> pd.DataFrame:
    new = arriving[["digest", "n_cp", "keep", "copies"]].assign(member=False)
    if not len(index):
        return new
    row = index.iloc[0]
    known = np.frombuffer(row["digests"], np.uint8).reshape(-1, 32)
    length, keep, copies = (np.frombuffer(row[c], np.int64).copy() for c in ("lengths", "ids", "copies"))
    if len(new):
        keys = as_matrix(new.digest)
        slot = MinimalPerfectHash.from_bytes(row["mph"]).slots(keys)
        member = slot >= 0
        member[member] = (known[slot[member]] == keys[member]).all(axis=1)
        at, n_cp, ids = slot[member], new.n_cp.to_numpy(np.int64)[member], new.keep.to_numpy(np.int64)[member]
        better = (n_cp > length[at]) | ((n_cp == length[at]) & (ids < keep[at]))
        length[at[better]], keep[at[better]] = n_cp[better], ids[better]
        copies[at] += new.copies.to_numpy(np.int64)[member]
        new = new[~member]
    old = pd.DataFrame({"digest": [bytes(x) for x in known], "n_cp": length, "keep": keep, "copies": copies, "member": True})
    return pd.concat([old, new], ignore_index=True)


def merge_history(arriving: DataFrame, history: DataFrame, shards: int) -> DataFrame:
    """Groups after the arrival of summed rows: members merged into their slots, nonmembers as new groups."""
    a = arriving.withColumn("shard", _shard(shards)).groupBy("shard")
    return a.cogroup(history.groupBy("shard")).applyInPandas(_lookup, GROUPS)


def annotate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", per_shard: int = PER_SHARD) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256, known for every row of docs.

    The table comes as two generations, dealt by a hash of the row's id: the first becomes the history, the
    second arrives against it (known: the text was in the history).
    """
    C.prepare(docs.sparkSession)
    rows = C.materialise(digests(docs, id_col, text_col).withColumn("arrives", F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 1), "digests")
    shards = C.shards_for(rows.count(), per_shard)
    history = build_history(summed(rows.where(~F.col("arrives"))), shards)
    groups = merge_history(summed(rows.where("arrives")), history, shards)
    groups = groups.select("digest", F.col("n_cp").alias("keep_cp"), "keep", "copies", "member")
    keep_id = F.when(F.col("keep") != NO_ID, F.col("keep"))
    return rows.join(groups, "digest").select(
        "doc_id", keep_id.alias("keep_id"), F.col("copies").alias("group_size"),
        (keep_id.eqNullSafe(F.col("doc_id")) & (F.col("keep_cp") == F.col("n_cp"))).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"), F.col("member").alias("known"),
    )


def drop_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, with all their columns."""
    kept = annotate(docs, id_col, text_col).where("kept")
    marks = C.materialise(kept.groupBy(F.col("doc_id").alias("id"), F.col("text_sha256").alias("sha")).agg(F.count(F.lit(1)).alias("times")), "kept")
    digest, size = (C.fresh(x, [*docs.columns, "id", "sha", "times"]) for x in ("digest_of_text", "size_of_text"))
    rows = docs.withColumns({digest: F.sha2(normalised(docs[text_col]), 256), size: F.length(F.coalesce(docs[text_col], F.lit("")))})
    rows = rows.join(marks, (rows[digest] == marks["sha"]) & rows[id_col].cast("long").eqNullSafe(marks["id"]))
    if marks.where("times > 1").take(1):  # rows repeat an id: of those the longest stays, whichever of equals
        longest = rows.groupBy(marks["id"].alias("its_id"), marks["sha"].alias("its_sha")).agg(F.max(rows[size]).alias("its_size"))
        own = rows[id_col].cast("long").eqNullSafe(longest["its_id"]) & (rows[digest] == longest["its_sha"]) & (rows[size] == longest["its_size"])
        rows = rows.join(longest, own, "left_semi").dropDuplicates([id_col, digest])
    return rows.select(*[docs[c] for c in docs.columns])


ORACLE = r"""
WITH rows AS (
  SELECT doc_id, length(coalesce(text, '')) AS n_cp,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents
), keepers AS (
  SELECT text_sha256, first(doc_id ORDER BY n_cp DESC, doc_id) AS keep_id, count(*) AS group_size
  FROM rows GROUP BY text_sha256
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM rows JOIN keepers USING (text_sha256)
"""


def op1_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return annotate(C.table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")
