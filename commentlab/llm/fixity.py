"""Merkle fixity audit of archive replicas.

Every record has a SHA-256 digest. In each archive the records of an offset range hash into a leaf, and
ranges hash in offset order into nodes of ``FANOUT`` children up to the archive's root; archive roots hash on
in the order of their numbers up to one root for the replica. Two replicas are compared from the top: only
the children of nodes that differ are looked at, down to the records of the differing ranges.

A level is one written table for all archives of both replicas; nodes gather a bounded number of children
(a leaf: the records that start in its range), whatever the size of an archive.

Cases: a record in one replica only is missing or extra; equal records given twice count once; a null
archive is an archive of its own; an empty replica differs in everything; two empty ones in nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from commentlab.operators.order import segmented_scan
from commentlab.session import cut_lineage

RANGE_BYTES = 1 << 16
FANOUT = 64
RECORDS_PER_ARCHIVE = 1000


def warc_record(url: Column, html: Column) -> Column:
    """The record's text as it is stored: headers, an empty line, the body, two line ends."""
    body = F.coalesce(html, F.lit(""))
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: resource\r\nWARC-Target-URI: "), F.coalesce(url, F.lit("")),
        F.lit("\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"),
    )
    return F.concat(head, body, F.lit("\r\n\r\n"))


def lay_out(records: DataFrame) -> DataFrame:
    """``offset`` of each (archive, record_id, length, digest) row: the bytes before it in its archive, in the
    order of record_id. The running sum is taken in parallel ranges, also within one large archive."""
    return segmented_scan(records, ["archive"], ["record_id", "digest"], {"offset": ("sum", "length", False)})


def _differing(nodes: DataFrame, keys: list[str]) -> DataFrame:
    a = F.max(F.when(F.col("replica") == "a", F.col("digest")))
    b = F.max(F.when(F.col("replica") == "b", F.col("digest")))
    return nodes.groupBy(*keys).agg(a.alias("_a"), b.alias("_b")).where(~F.col("_a").eqNullSafe(F.col("_b"))).select(*keys)


def _parents(nodes: DataFrame, keys: list[Column], order: list[str]) -> DataFrame:
    children = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(*order, "digest"))), lambda c: F.concat_ws(":", *[c[o].cast("string") for o in order], c["digest"])), "|")
    return nodes.groupBy("replica", *keys).agg(F.sha2(children, 256).alias("digest"))


def build_levels(records: DataFrame, range_bytes: int = RANGE_BYTES, fanout: int = FANOUT) -> list[DataFrame]:
    """Written node tables from the leaves to the root: ``(replica, a, i, digest)``.

    Below the archive roots ``a`` is the archive's place and ``i`` the node's in it; above them i is 0 and a the
    place of a node over archives, as it is counted on its level. Places count from 0, so that they meet in one root.
    """
    leaves = _parents(records, [F.col("a"), F.floor(F.col("offset") / range_bytes).cast("bigint").alias("i")], ["offset", "length"])
    levels = [cut_lineage(leaves, "leaves")]
    while (top := levels[-1].agg(F.max("i").alias("i"), F.max("a").alias("a")).first())["a"] is not None:
        if top["i"] > 0:
            above = _parents(levels[-1], [F.col("a"), F.floor(F.col("i") / fanout).cast("bigint").alias("i")], ["i"])
        elif top["a"] > 0:
            above = _parents(levels[-1], [F.floor(F.col("a") / fanout).cast("bigint").alias("a"), F.lit(0).cast("bigint").alias("i")], ["a"])
        else:
            break
        levels.append(cut_lineage(above, "nodes"))
    return levels


def descend(levels: list[DataFrame], fanout: int = FANOUT) -> DataFrame:
    """``(a, i)`` of the leaves that differ: from the root down, only children of differing nodes."""
    bad = cut_lineage(_differing(levels[-1], ["a", "i"]), "differing")
    heights = [lv.agg(F.max("i")).first()[0] or 0 for lv in levels]
    for k in range(len(levels) - 2, -1, -1):
        inside = heights[k] > 0  # this level's parents are nodes of the same archive
        up_a = F.col("a") if inside else F.floor(F.col("a") / fanout).cast("bigint")
        up_i = F.floor(F.col("i") / fanout).cast("bigint") if inside else F.lit(0).cast("bigint")
        parents = bad.withColumnsRenamed({"a": "_pa", "i": "_pi"})
        below = levels[k].join(parents, (up_a == F.col("_pa")) & (up_i == F.col("_pi")), "left_semi")
        bad = cut_lineage(_differing(below, ["a", "i"]), "differing")
    return bad


def audit(a: DataFrame, b: DataFrame, range_bytes: int = RANGE_BYTES, fanout: int = FANOUT) -> DataFrame:
    """Damage of replica ``b`` against ``a``, both (archive, offset, length, record_id, digest): archive, offset,
    record_id, kind (changed, missing, extra), and length (0 where absent) and digest on either side."""
    cols = ["archive", "offset", "length", "record_id", "digest"]
    records = a.select(F.lit("a").alias("replica"), *cols).unionByName(b.select(F.lit("b").alias("replica"), *cols))
    records = cut_lineage(records.distinct(), "records")
    low = records.agg(F.min("archive")).first()[0] or 0
    records = records.withColumn("a", F.coalesce(F.col("archive") - F.lit(low) + 1, F.lit(0)).cast("bigint"))
    levels = build_levels(records, range_bytes, fanout)
    bad = descend(levels, fanout)
    near = records.withColumn("i", F.floor(F.col("offset") / range_bytes).cast("bigint")).join(bad, ["a", "i"], "left_semi")
    sides = near.groupBy("archive", "offset").agg(
        *[F.sort_array(F.collect_list(F.when(F.col("replica") == r, F.struct("length", "digest", "record_id")))).alias(f"in_{r}") for r in "ab"]
    )
    sides = sides.where(F.col("in_a") != F.col("in_b"))
    kind = F.when(F.size("in_b") == 0, "missing").when(F.size("in_a") == 0, "extra").otherwise("changed")
    one = {r: F.try_element_at(F.col(f"in_{r}"), F.lit(1)) for r in "ab"}
    return sides.select(
        "archive", "offset", F.coalesce(one["a"]["record_id"], one["b"]["record_id"]).alias("record_id"), kind.alias("kind"),
        *[F.coalesce(one[r]["length"], F.lit(0).cast("bigint")).alias(f"length_{r}") for r in "ab"],
        *[one[r]["digest"].alias(f"digest_{r}") for r in "ab"],
    )


def damaged_pair(pages: DataFrame, per_archive: int = RECORDS_PER_ARCHIVE) -> tuple[DataFrame, DataFrame]:
    """Two replicas of ``pages`` as archives of ``per_archive`` ids each. The second one is damaged in place by a
    rule on page_id: every 97th record has its last body character replaced, every 193rd is gone."""
    page = F.coalesce("page_id", F.lit(-1))
    hurt = F.when(page % 97 == 13, F.concat(F.expr("substring(html, 1, length(html) - 1)"), F.lit("\u0000"))).otherwise(F.col("html"))
    whole, copy = warc_record(F.col("url"), F.col("html")), warc_record(F.col("url"), hurt)
    hashed = pages.select(
        F.floor(F.col("page_id") / per_archive).cast("bigint").alias("archive"), F.col("page_id").alias("record_id"),
        F.octet_length(whole).cast("bigint").alias("length"), F.sha2(whole, 256).alias("digest"),
        F.octet_length(copy).cast("bigint").alias("length_b"), F.sha2(copy, 256).alias("digest_b"),
    )
    a = cut_lineage(lay_out(hashed), "replica")
    cols = ["archive", "offset", "record_id"]
    b = a.where(F.coalesce("record_id", F.lit(-1)) % 193 != 7)
    return a.select(*cols, "length", "digest"), b.select(*cols, F.col("length_b").alias("length"), F.col("digest_b").alias("digest"))
