"""Exact dedup by Golomb-coded fingerprint exchange.

A sender is a bucket of documents (by hash of doc_id).  It sorts the fingerprints of its documents and sends each
range of the fingerprint space to its owner as one Golomb-coded block.  An owner decodes the blocks of its
range, marks every fingerprint that it holds twice or more, and returns one bit for each position of each block.
The sender's set bits are its suspects; only their texts are shuffled, grouped by the bytes themselves.

Fingerprints are 64-bit hashes, so a suspect may be a false alarm; the byte comparison decides, and no copy can
be missed.  Every document goes to one sender and every range to one owner; the counts of both follow the number
of documents, so that a block, a sender and an owner stay small.  Copies of one text inside a sender are one
fingerprint in its block, with a flag, so a hot text costs one code in each sender.

Null texts count as empty ones.  Rows with a null doc_id are documents too; when all copies of a text have a
null doc_id, keep_id is null and kept is true.  A repeated row (equal doc_id and text) is a copy like any other; all rows
that carry the largest doc_id are marked kept.  An empty table gives an empty table.
Texts of any length are compared whole.  Other columns, whatever their names, are not read.
"""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from pulsegrid.session import cut_lineage

from .golomb import decode, encode

#: Documents of a sender and fingerprints of an owner, about.
PER_SENDER = 50_000
#: Suspect fingerprints that may be broadcast (8 bytes each); more are joined by shuffle.
BROADCAST_SUSPECTS = 1_000_000


def _owner(fp: np.ndarray, owners: int) -> np.ndarray:
    """Owners hold equal ranges of the upper 32 bits."""
    return ((fp >> np.uint64(32)) * np.uint64(owners) >> np.uint64(32)).astype(np.int64)


def _lowest(owner: int, owners: int) -> np.uint64:
    return np.uint64((-(-(owner << 32) // owners)) << 32)


def _send(owners: int):
    def send(key, pdf):
        fp, count = np.unique(pdf.fp.to_numpy().view(np.uint64), return_counts=True)
        owner = _owner(fp, owners)
        cut = np.searchsorted(owner, np.arange(owners + 1))
        rows = [(key[0], o, encode(fp[a:b] - _lowest(o, owners)), np.packbits(count[a:b] > 1).tobytes())
                for o, (a, b) in enumerate(zip(cut[:-1], cut[1:])) if b > a]
        return pd.DataFrame(rows, columns=["sender", "owner", "block", "twice"])

    return send


def _own(key, pdf):
    """Bitmaps of the positions whose fingerprint occurs again, for the blocks of one range."""
    blocks = [decode(b) for b in pdf.block]
    values, count = np.unique(np.concatenate(blocks), return_counts=True)
    again = values[count > 1]
    rows = []
    for sender, b, twice in zip(pdf.sender, blocks, pdf.twice):
        hit = np.isin(b, again) | np.unpackbits(np.frombuffer(twice, np.uint8))[:len(b)].astype(bool)
        if hit.any():
            rows.append((sender, key[0], np.packbits(hit).tobytes()))
    return pd.DataFrame(rows, columns=["sender", "owner", "bitmap"])


def _receive(owners: int):
    def receive(key, mine, maps):
        fp = np.unique(mine.fp.to_numpy().view(np.uint64)) if len(mine) else np.zeros(0, np.uint64)
        owner = _owner(fp, owners)
        out = [fp[:0]]
        for o, bitmap in zip(maps.owner, maps.bitmap):
            a, b = np.searchsorted(owner, [o, o + 1])
            out.append(fp[a:b][np.unpackbits(np.frombuffer(bitmap, np.uint8))[:b - a].astype(bool)])
        return pd.DataFrame({"fp": np.concatenate(out).view(np.int64)})

    return receive


def suspects(prints: DataFrame, rows: int) -> DataFrame:
    """Distinct fingerprints that occur twice or more among ``prints`` (sender, fp)."""
    owners = max(1, -(-rows // PER_SENDER))
    sent = prints.groupBy("sender").applyInPandas(_send(owners), "sender long, owner int, block binary, twice binary")
    maps = sent.groupBy("owner").applyInPandas(_own, "sender long, owner int, bitmap binary")
    back = prints.groupBy("sender").cogroup(maps.groupBy("sender")).applyInPandas(_receive(owners), "fp long")
    return back.distinct()


def exact_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every document; of equal texts the largest doc_id stays."""
    text = F.coalesce("text", F.lit(""))
    slim = cut_lineage(docs.select("doc_id", F.xxhash64(text).alias("fp"), F.sha2(text.cast("binary"), 256).alias("text_sha256")))
    rows = slim.count()
    senders = max(1, -(-rows // PER_SENDER))
    # A text that a third of the documents share stays spread over all senders: the bucket is of the doc_id and,
    # for rows without one, of the fingerprint.
    prints = slim.select(F.pmod(F.xxhash64("doc_id", F.when(F.col("doc_id").isNull(), F.col("fp"))), F.lit(senders)).alias("sender"), "fp")
    found = cut_lineage(suspects(prints, rows))
    side = F.broadcast(found) if found.count() <= BROADCAST_SUSPECTS else found
    copies = docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("fp")).join(side, "fp", "left_semi")
    # Grouping by the text compares bytes; copies meet in partial sums before the shuffle.
    groups = copies.groupBy("text").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    groups = groups.where("group_size > 1").select(F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"), "keep_id", "group_size")
    out = slim.join(groups, "text_sha256", "left")
    lone = F.col("group_size").isNull()
    keep = F.when(lone, F.col("doc_id")).otherwise(F.col("keep_id"))
    return out.select("doc_id", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
                      F.col("doc_id").eqNullSafe(keep).alias("kept"), "text_sha256")
