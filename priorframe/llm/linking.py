"""Connected components and bucketed similarity linking as joins and aggregates.

A bucketed similarity search compares rows that share a bucket. Emitting every pair of a bucket grows with the
square of the largest group of near copies, so :func:`link_buckets` works in two rounds and loses no link:

1. every id is compared with the smallest home member of one of its buckets only, which is linear;
2. pairs are compared where both are still in different components. A bucket whose members are all connected
   by then has nothing left to find, because only connectivity is reported.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .scratch import Scratch

MAX_ROUNDS = 200
#: Two longs each, so at most 32 MB go to every task.
BROADCAST_BUCKETS = 1_000_000
#: Members of a bucket, on either side, that meet at once.
BUCKET_PART = 200
#: Rounds of further leads at most, made while there are more than this many pairs a member.
STARS = 6
FEW_PAIRS = 4


def connected_components(scratch: Scratch, edges: DataFrame, name: str = "cc") -> DataFrame:
    """``edges(a, b)`` to ``(id, comp)``: comp is the smallest id that can be reached from id.

    Ids without an edge do not occur in the result; loops, repeated edges and an empty table are fine. Ids may be
    of any orderable type. Each round takes the smallest label among an id and its neighbours, and the label of that
    label, so the number of rounds grows with the logarithm of a component's diameter in practice.
    """
    pairs = edges.where(F.col("a") != F.col("b")).select("a", "b")
    # both directions from one evaluation: a union would test every edge twice
    ways = F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"))))
    links = scratch.save(pairs.select(ways.alias("way")).select("way.a", "way.b").distinct(), f"{name}-links")
    labels = links.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("low"))
    labels = scratch.save(labels.select("id", F.least("id", "low").alias("comp")), f"{name}-0")
    for k in range(1, MAX_ROUNDS):
        own = labels.select("id", "comp", F.col("comp").alias("old"))
        near = links.join(labels.withColumnRenamed("id", "b"), "b").select(F.col("a").alias("id"), "comp")
        hop = labels.select("id", F.col("comp").alias("via")).join(
            labels.select(F.col("id").alias("via"), "comp"), "via"
        )
        none = F.lit(None).cast(labels.schema["comp"].dataType)
        found = own.unionByName(near.select("id", "comp", none.alias("old"))).unionByName(
            hop.select("id", "comp", none.alias("old"))
        )
        after = scratch.save(found.groupBy("id").agg(F.min("comp").alias("comp"), F.min("old").alias("old")), f"{name}-{k}")
        labels = after.select("id", "comp")
        scratch.drop(f"{name}-{k - 1}")
        if after.where(F.col("comp") != F.col("old")).isEmpty():
            scratch.drop(f"{name}-links")
            return labels
    raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")


def link_buckets(
    scratch: Scratch,
    members: DataFrame,
    near: Callable[[Column, Column], Column] | None = None,
    verify: Callable[[DataFrame], DataFrame] | None = None,
    marks: DataFrame | None = None,
    details: Callable[[DataFrame], DataFrame] | None = None,
    agree: Callable[[Column, Column], Column] | None = None,
    source: str | None = None,
) -> DataFrame:
    """``members(bucket, id, home)`` to ``(id, comp)`` of the ids that have a link.

    Two ids are linked if they share a bucket where at least one is at home, ``near`` holds for their marks and
    ``verify`` keeps their pair ``(a, b)``. An id occurs at most once in a bucket. ``marks(id, mark)`` has the marks; an
    id is its own mark without it.

    With ``details`` and ``agree`` the second round compares pairs where they meet and writes none but links: ``details``
    turns ids into ``(id, detail)``, and ``agree(detail, detail)`` says what ``verify`` would.

    ``source`` names the table of ``scratch`` that the members come from, if nothing else reads it. Tables are deleted as soon
    as nothing reads them, so that the disk holds one step of the work and not all of them.
    """
    near = near or (lambda a, b: F.lit(True))
    verify = verify or (lambda pairs: pairs)
    # Most buckets hold one id. A bucket's ids are summed up before the shuffle, so that a hot bucket is no hot task.
    bucket = members.groupBy("bucket").agg(
        F.min(F.when(F.col("home"), F.col("id"))).alias("lead"), F.min("id").alias("low"), F.max("id").alias("high")
    )
    shared = scratch.save(bucket.where((F.col("low") != F.col("high")) & F.col("lead").isNotNull()).select("bucket", "lead"), "shared")
    shared = F.broadcast(shared) if shared.count() <= BROADCAST_BUCKETS else shared
    # an id that occurs again in a bucket (equal lines) would meet its pairs once for each two occurrences
    close = members.join(shared, "bucket").where(F.col("id") != F.col("lead")).distinct()
    close = scratch.save(close, "close")
    scratch.drop("shared", *([source] if source else []))
    own_marks = marks is not None
    marks = close.select("id", F.col("id").alias("mark")).distinct() if marks is None else marks
    first = close.groupBy("id", "lead").agg(F.count("*").alias("n")).join(marks, "id")
    first = first.join(marks.select(F.col("id").alias("lead"), F.col("mark").alias("lead_mark")), "lead", "left")
    first = first.where(near(F.col("mark"), F.coalesce("lead_mark", "lead")))
    # an id is compared with the lead that it meets most often; the other leads wait for the second round
    first = first.groupBy("id").agg(F.max(F.struct("n", "lead")).alias("m")).select(F.col("m.lead").alias("a"), F.col("id").alias("b"))
    one = connected_components(scratch, verify(first), "one")

    leads = close.select("bucket", F.col("lead").alias("id"), F.lit(True).alias("home")).distinct()
    rows = close.select("bucket", "id", "home").unionByName(leads)
    if agree is not None:
        one, left, read = _linked_by_stars(scratch, rows, one, marks, near, details, agree, ["close"] if own_marks else [])
        second = scratch.save(_linked_in_place(left, near, agree), "apart")
        scratch.drop(read)
    else:
        left = scratch.save(_mixed(scratch, rows, one, "placed").join(marks, "id", "left").withColumn("mark", F.coalesce("mark", "id")), "left")
        x, y = left.where("home").alias("x"), left.alias("y")
        apart = x.join(y, F.col("x.bucket") == F.col("y.bucket")).where(
            (F.col("x.comp") != F.col("y.comp")) & (~F.col("y.home") | (F.col("x.id") < F.col("y.id"))) & near(F.col("x.mark"), F.col("y.mark"))
        )
        pairs = apart.select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b")).distinct()
        second = scratch.save(verify(pairs), "apart")
    return one if second.isEmpty() else _merged(scratch, one, second, "two")


def _mixed(scratch: Scratch, rows: DataFrame, one: DataFrame, name: str) -> DataFrame:
    """The members ``(bucket, id, home, comp)`` of buckets that hold more than one component."""
    placed = scratch.save(rows.join(one, "id", "left").withColumn("comp", F.coalesce("comp", "id")).select("bucket", "id", "home", "comp"), name)
    mixed = placed.groupBy("bucket").agg(F.min("comp").alias("low"), F.max("comp").alias("high"))
    mixed = scratch.save(mixed.where(F.col("low") != F.col("high")).select("bucket"), f"{name}-mixed")
    return placed.join(mixed, "bucket", "left_semi")


def _merged(scratch: Scratch, one: DataFrame, links: DataFrame, name: str) -> DataFrame:
    """The components ``one(id, comp)`` with the links ``(a, b)``, whose ids need not be in one."""
    comp = lambda end: one.select(F.col("id").alias(end), F.col("comp").alias(f"comp_{end}"))
    higher = links.join(comp("a"), "a", "left").join(comp("b"), "b", "left")
    higher = higher.select(F.coalesce("comp_a", "a").alias("a"), F.coalesce("comp_b", "b").alias("b"))
    two = connected_components(scratch, higher, name)
    every = one.unionByName(two.join(one, "id", "left_anti").select("id", F.col("id").alias("comp")))
    tops = two.select(F.col("id").alias("comp"), F.col("comp").alias("top"))
    joined = every.join(tops, "comp", "left").select("id", F.coalesce("top", "comp").alias("comp"))
    return scratch.save(joined, f"{name}-linked")


def _shares(left: DataFrame) -> DataFrame:
    """``left`` with ``most``, the component that has most of a bucket's members, and how many are in it (``inside``) or not (``outside``)."""
    held = left.groupBy("bucket", "comp").agg(F.count("*").alias("n"))
    most = held.groupBy("bucket").agg(F.max(F.struct("n", "comp")).alias("top"), F.sum("n").alias("every"))
    most = most.select("bucket", F.col("top.comp").alias("most"), F.col("top.n").alias("inside"), (F.col("every") - F.col("top.n")).alias("outside"))
    return left.join(most, "bucket")


def _linked_by_stars(
    scratch: Scratch, rows: DataFrame, one: DataFrame, marks: DataFrame, near: Callable, details: Callable, agree: Callable, done: list[str]
) -> tuple[DataFrame, DataFrame, str]:
    """Components merged by further leads, the members ``left`` of buckets that are mixed even so, and the table these are in.

    The tables ``done`` are deleted once the members are placed.

    Near copies of which many differ from the first lead would all meet each other. While pairs are many more than members,
    every member outside a bucket's largest component is compared with one of its members, another in each round. Only
    links come of it, and no pair is left out: what is still apart meets in full.
    """
    left = scratch.save(_mixed(scratch, rows, one, "placed").join(marks, "id", "left").withColumn("mark", F.coalesce("mark", "id")), "left")
    scratch.drop("placed", "placed-mixed", *done)
    read = "left"
    found = details(left.select("id").distinct())
    for k in range(STARS):
        shares = scratch.save(_shares(left), f"shares-{k}")
        pairs, members = shares.select(
            F.coalesce(F.sum(F.when(F.col("comp") != F.col("most"), F.col("inside") + F.col("outside") / 2)), F.lit(0)), F.count("*")
        ).first()
        if pairs <= FEW_PAIRS * members:
            break
        order = F.xxhash64("id", F.lit(k))
        leads = shares.where(F.col("comp") == F.col("most")).groupBy("bucket").agg(F.min(F.struct(order, "id", "home", "mark")).alias("star"))
        met = shares.where((F.col("comp") != F.col("most")) & (F.col("inside") > 1)).join(leads, "bucket")
        met = met.where((F.col("home") | F.col("star.home")) & near(F.col("mark"), F.col("star.mark")))
        met = met.groupBy("id", "star.id").agg(F.count("*").alias("n")).toDF("b", "a", "n")
        met = met.groupBy("b").agg(F.max(F.struct("n", F.xxhash64("a", F.lit(k)), "a")).alias("m")).select(F.col("m.a").alias("a"), "b")
        text = lambda end: found.select(F.col("id").alias(end), F.col("detail").alias(f"detail_{end}"))
        both = met.join(text("a"), "a").join(text("b"), "b").repartition(scratch.parts(), "b")
        links = scratch.save(both.where(agree(F.col("detail_a"), F.col("detail_b"))).select("a", "b"), f"star-{k}")
        scratch.drop(f"shares-{k}")
        if links.isEmpty():
            continue
        one = _merged(scratch, one, links, f"stars-{k}")
        left = scratch.save(_mixed(scratch, left.select("bucket", "id", "home"), one, f"placed-{k}").join(marks, "id", "left").withColumn("mark", F.coalesce("mark", "id")), f"left-{k}")
        scratch.drop(f"placed-{k}", f"placed-{k}-mixed", read)
        read = f"left-{k}"
    return one, left.join(found, "id"), read


def _linked_in_place(left: DataFrame, near: Callable, agree: Callable) -> DataFrame:
    """Links ``(a, b)`` between members of a bucket that are in different components, tested inside the join.

    No pair is written or moved: the members move. Of each pair one member at least is outside the bucket's largest
    component; those members and all are cut in parts that meet part by part, so copies are a hundredth of the pairs. A
    pair is tested in the lowest bucket that both share only.
    """
    shared = left.groupBy("id").agg(F.array_sort(F.collect_list("bucket")).alias("buckets"))
    rows = _shares(left).join(shared, "id")
    outer, parts = F.col("comp") != F.col("most"), lambda n: F.ceil(n / BUCKET_PART)
    deal = lambda n: F.pmod(F.xxhash64("id"), parts(n))
    copies = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), parts(n) - 1))
    every = F.col("inside") + F.col("outside")
    x = rows.where(outer).withColumn("row", deal(F.col("outside"))).withColumn("part", copies(every)).alias("x")
    y = rows.withColumn("outer", outer).withColumn("row", copies(F.col("outside"))).withColumn("part", deal(every)).alias("y")
    met = (F.col("x.bucket") == F.col("y.bucket")) & (F.col("x.row") == F.col("y.row")) & (F.col("x.part") == F.col("y.part"))
    met = met & (F.col("x.comp") != F.col("y.comp")) & (~F.col("y.outer") | (F.col("x.id") < F.col("y.id"))) & (F.col("x.home") | F.col("y.home"))
    met = met & near(F.col("x.mark"), F.col("y.mark")) & (F.array_min(F.array_intersect("x.buckets", "y.buckets")) == F.col("x.bucket"))
    links = x.join(y, met & agree(F.col("x.detail"), F.col("y.detail")))
    return links.select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b")).distinct()
