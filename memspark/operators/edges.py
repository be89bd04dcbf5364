"""Dated edges after a batch of updates, without a pass over a whole key.

A stored dated edge ends the open edges of its subject and predicate that point elsewhere and did not start
later, and an edge that looks like a stored one is skipped. Read backwards, an open edge ends at the first later
edge of its key that has another object, starts no earlier, and is not skipped. All edges are range-partitioned by
(key, arrival), so a key of any size is a row of buckets, numbered through by ``at``. A stretch of edges is summed
up by its largest start and the largest one of any other object; sums of neighbours combine, so binary jumps find the
first edge that ends another, inside a bucket as well as over the buckets of a key. Only keys that lie across a
bucket's end, at most one for each, need the second step.

Whether an edge is skipped depends on what ended before it, and what it ends on whether it is skipped. Both follow from
earlier edges alone, so the two are worked out in turn until nothing changes; without repeated edges once is enough.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from memspark.operators.kernels import close_in_bucket, close_in_cell, closing_bucket
from memspark.operators.scope import SCOPE
from memspark.session import materialize

EDGE = [*SCOPE, "subject_id", "predicate"]
LOOK = [*EDGE, "object_id", "valid_from", "valid_until"]
#: Edges of a bucket, and edges that look for their end in one bucket of another task.
BUCKET_ROWS, ASKING_ROWS = 200_000, 100_000
_NEVER = (1 << 63) - 1


def in_buckets(rows: DataFrame, order: list[str], bucket_rows: int) -> DataFrame:
    """``rows`` written with ``at``, which numbers them in ``order``, and ``bucket``."""
    spark = rows.sparkSession
    buckets = max(-(-rows.count() // bucket_rows), int(spark.conf.get("spark.sql.shuffle.partitions")))
    placed = rows.repartitionByRange(buckets, *order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    return materialize(placed.withColumn("bucket", F.shiftright("at", 33)), "edges")


def ends_of(placed: DataFrame, skipped: DataFrame | None) -> DataFrame:
    """``at`` of every open edge that ends, with ``end_at`` and ``end_from`` of the edge that ends it.

    ``skipped`` (at) are not stored and end nothing; when they would end is told all the same.
    """
    if skipped is None:
        marked = placed.withColumn("ends", (F.col("is_new") == 1) & F.col("valid_from").isNotNull())
    else:
        marked = placed.join(skipped.withColumn("_skip", F.lit(True)), "at", "left").withColumn(
            "ends", (F.col("is_new") == 1) & F.col("valid_from").isNotNull() & F.col("_skip").isNull()
        )
    marked = marked.withColumn("open", F.col("valid_until").isNull()).select(*EDGE, "object_id", "valid_from", "at", "bucket", "ends", "open")
    found = "at long, end_at long, end_from date, asks boolean"
    inside = materialize(marked.groupBy("bucket").applyInPandas(close_in_bucket(EDGE), found), "ends")
    done = inside.filter(~F.col("asks")).select("at", "end_at", "end_from")
    # keys across buckets; each bucket ends inside one key, so these are few
    split = placed.groupBy(*EDGE).agg(F.min("bucket").alias("_low"), F.max("bucket").alias("_high")).filter("_low < _high").select(*EDGE)
    wide = marked.join(split, EDGE, "left_semi")
    most = wide.filter("ends").groupBy(*EDGE, "bucket", "object_id").agg(F.max("valid_from").alias("most"))
    two = F.row_number().over(W.partitionBy(*EDGE, "bucket").orderBy(F.desc("most"), "object_id"))
    sums = most.withColumn("_nth", two).filter("_nth <= 2").drop("_nth").toPandas()  # two rows for each bucket of such a key
    if sums.empty:
        return done
    asking = wide.join(inside.filter("asks").select("at"), "at", "left_semi").select(*EDGE, "bucket", "object_id", "valid_from", "at")
    asking = materialize(asking.mapInPandas(closing_bucket(EDGE, sums), asking.schema), "asking")
    cell = [*EDGE, "bucket"]
    shares = asking.groupBy(*cell).agg(F.ceil(F.count(F.lit(1)) / ASKING_ROWS).cast("int").alias("shares"))
    ask = asking.join(shares, cell).withColumn("share", F.pmod(F.xxhash64("at"), F.col("shares")).cast("int"))
    ends = wide.filter("ends").join(shares, cell).withColumn("share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)))
    columns = [*cell, "share", "object_id", "valid_from", "at"]
    late = ends.select(*columns).groupBy(*cell, "share").cogroup(ask.select(*columns).groupBy(*cell, "share")).applyInPandas(close_in_cell(), "at long, end_at long, end_from date")
    return done.unionByName(late)


def _repeats(placed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges that may turn out to be skipped: open ones that look alike, and new ones with an end of their own."""
    dated = placed.filter(F.col("valid_until").isNull() & F.col("valid_from").isNotNull())
    look = [*EDGE, "object_id", "valid_from"]
    again = dated.groupBy(*look).agg(F.count(F.lit(1)).alias("_n"), F.max("is_new").alias("_new")).filter("_n > 1 AND _new = 1").select(*look)
    return dated.join(again, look, "left_semi"), placed.filter("valid_until IS NOT NULL")


def skips_of(placed: DataFrame, alike: DataFrame, ended: DataFrame, ends: DataFrame) -> DataFrame:
    """``at`` of the new edges that look like a stored one when they come."""
    look = [*EDGE, "object_id", "valid_from"]
    rows = alike.join(ends, "at", "left").select(*look, "at", "bucket", "is_new", F.coalesce("end_at", F.lit(_NEVER)).alias("_end"))
    inside = W.partitionBy(*look, "bucket").orderBy("at")
    rows = rows.withColumn("_before", F.lag("_end").over(inside))
    last = rows.groupBy(*look, "bucket").agg(F.max_by("_end", "at").alias("_last"))  # one row for each bucket of a look
    last = last.withColumn("_carried", F.lag("_last").over(W.partitionBy(*look).orderBy("bucket"))).drop("_last")
    rows = rows.join(last, [*look, "bucket"]).withColumn("_before", F.coalesce("_before", "_carried"))
    open_ = rows.filter("is_new = 1 AND _before > at").select("at")  # the one before has not ended yet
    stored = ended.groupBy(*LOOK).agg(F.min("at").alias("_since"))
    closed = placed.join(ends, "at").filter("valid_until IS NULL").groupBy(*look, F.col("end_from").alias("valid_until")).agg(F.min("end_at").alias("_since"))
    since = stored.unionByName(closed.select(*LOOK, "_since")).groupBy(*LOOK).agg(F.min("_since").alias("_since"))
    e, s = ended.filter("is_new = 1").alias("e"), since.alias("s")
    same = F.lit(True)
    for c in LOOK:
        same = same & F.col(f"e.{c}").eqNullSafe(F.col(f"s.{c}"))
    return open_.unionByName(e.join(s, same).filter("_since < at").select("e.at"))


def upsert(existing: DataFrame, fresh: DataFrame, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """All edges after ``fresh`` ones (with ``arrival``) came in, in arrival order; ``existing`` ones are stored already."""
    undated = F.col("valid_from").isNull() & F.col("valid_until").isNull()
    first = fresh.filter(undated).groupBy(*LOOK).agg(F.min("arrival").alias("arrival"))
    new = fresh.filter(~undated).select(*LOOK, "arrival").unionByName(first.select(*LOOK, "arrival"))
    new = new.select(*LOOK, F.col("arrival").cast("long").alias("arrival"), F.lit(1).alias("is_new")).groupBy(*LOOK, "arrival", "is_new").agg(F.lit(1).cast("long").alias("copies"))
    old = existing.groupBy(*LOOK).agg(F.count(F.lit(1)).alias("copies")).select(*LOOK, F.lit(None).cast("long").alias("arrival"), F.lit(0).alias("is_new"), "copies")
    order = [*EDGE, "is_new", "arrival", "object_id", "valid_from", "valid_until"]
    placed = in_buckets(old.unionByName(new), order, bucket_rows)
    # an edge without dates says nothing once its object is known, and ends nothing
    known = placed.groupBy(*EDGE, "object_id").agg(F.min("at").alias("_first"))
    bare = placed.filter(undated & (F.col("is_new") == 1)).join(known, [*EDGE, "object_id"]).filter("_first < at").select("at")
    placed = materialize(placed.join(bare, "at", "left_anti"), "edges")

    alike, ended = (materialize(r, "repeats") for r in _repeats(placed))
    ends, skipped, n = materialize(ends_of(placed, None), "closed"), None, 0
    while alike.head(1) or ended.filter("is_new = 1").head(1):
        now = materialize(skips_of(placed, alike, ended, ends).distinct(), "skipped")
        many = now.count()
        if many == n and (not n or not now.join(skipped, "at", "left_anti").head(1)):
            break
        skipped, n = now, many
        ends = materialize(ends_of(placed, skipped), "closed")
    if skipped is not None:
        placed = placed.join(skipped, "at", "left_anti")
    closed = placed.join(ends.select("at", "end_from"), "at", "left").withColumn("valid_until", F.coalesce("valid_until", "end_from"))
    return closed.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select(*LOOK, "arrival")
