"""Mixing sources to target weights under a time-varying curriculum.

Each source has a weight and a schedule, a piecewise-linear level over training time 0..1. The schedule's
integral is the source's cumulative token demand; a copy of a document that starts after a share x of its
source's words is trained on at the time by which the demand has reached x. Documents are then
range-sorted by that position. Within a source documents come in the order of a hash of their id, again
in each of at most MOST passes.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from patraka.llm.common import materialize

WEIGHTS = (5, 2, 1)
MOST = 3
NEAR = 0.001  # of a target: what is left of it below this is not handed on to smaller documents
#: One schedule for each weight, repeating like them: (time, level) knots. Heavy sources come early.
SCHEDULES = (
    ((0.0, 1.25), (0.5, 1.0), (1.0, 0.75)),
    ((0.0, 1.0), (1.0, 1.0)),
    ((0.0, 0.5), (0.5, 0.75), (1.0, 2.0)),
)
WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    """Runs of anything but blanks; a null text has none."""
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(WORD)), F.lit(0)).cast("long")


def sizes(docs: DataFrame) -> DataFrame:
    """``(doc_id, source, text_hash, size, turn)`` by row; turn: the digest that orders a source's documents, alike on any engine.

    Rows without an id are ordered by their texts.
    """
    name = F.coalesce(F.col("doc_id").cast("string"), F.md5(F.coalesce(F.col("text").cast("string"), F.lit(""))))
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        F.xxhash64("text").alias("text_hash"),
        n_words(F.col("text")).alias("size"),
        F.md5(F.concat(name, F.lit("|mix"))).alias("turn"),
    )


def targets(by_source: DataFrame, weights: Sequence[float] = WEIGHTS, most: int = MOST) -> DataFrame:
    """Add ``place``, ``weight`` and ``target`` to ``(source, source_size)``; place: the rank by code point, null last.

    All sizes together are shared out by weight; a target stops at ``most`` times its source's size and
    the excess is shared again among the others, until none is above.
    """
    # One row a source, so that the ranking's single task is small.
    order = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = by_source.withColumn("place", F.row_number().over(order) - 1)
    weight = F.lit(float(weights[-1]))
    for i, w in enumerate(weights[:-1]):
        weight = F.when(F.col("place") % len(weights) == i, float(w)).otherwise(weight)
    ranked = materialize(ranked.withColumn("weight", weight))
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    cap = F.col("source_size") * float(most)
    rate, capped = 0.0, -1
    while total:
        above = (F.col("weight") * rate > cap) if capped >= 0 else F.lit(False)
        got = ranked.agg(
            F.sum(F.when(above, 1).otherwise(0)).alias("n"), F.sum(F.when(above, cap).otherwise(0.0)).alias("full"), F.sum(F.when(above, 0.0).otherwise(F.col("weight"))).alias("w")
        ).first()
        if got["n"] == capped or not got["w"]:
            break
        capped, rate = got["n"], (total - got["full"]) / got["w"]
    return ranked.withColumn("target", F.least(cap, F.col("weight") * rate))


def position(share: Column, schedule: Sequence[tuple[float, float]]) -> Column:
    """Training time at which a schedule's cumulative demand reaches ``share`` of its whole."""
    area = [(b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(schedule, schedule[1:])]
    whole = sum(area)
    out, before = F.lit(float(schedule[-1][0])), whole
    for (t0, l0), (t1, l1), part in reversed(list(zip(schedule, schedule[1:], area))):
        before -= part
        need = F.greatest(share * whole - before, F.lit(0.0))
        slope = (l1 - l0) / (t1 - t0)
        # level * t + slope * t^2 / 2 = need, in the form that holds for a slope of 0 too
        t = t0 + F.coalesce(F.try_divide(2 * need, l0 + F.sqrt(F.greatest(l0 * l0 + 2 * slope * need, F.lit(0.0)))), F.lit(0.0))
        out = F.when(share * whole < before + part, F.least(t, F.lit(t1))).otherwise(out)
    return out


def plan(docs: DataFrame, weights: Sequence[float] = WEIGHTS, schedules=SCHEDULES, most: int = MOST, near: float = NEAR) -> DataFrame:
    """One row for each distinct ``(doc_id, source, text_hash)`` with the copies that the mix takes.

    Columns: those three, ``size``, ``n`` (rows alike), ``source_size``, ``target``, ``takes`` (copies of all
    rows alike; the first ``takes % n`` of them have one more than the others), ``parts`` (rows
    ``low`` to ``high`` taken one after another from ``start`` words on) and ``positions`` (of their starts).

    A source's documents are gone through in order, ``most`` times over, and each that fits what is left of the
    target is taken. Once one has not fitted and no more than ``near`` of the target is left, the rest
    stay. The words that are left then go to the one document nearest in size, if that comes nearer to the
    target. A document without a word is not taken.
    """
    own = materialize(sizes(docs).groupBy("doc_id", "source", "text_hash", "size", "turn").agg(F.count("*").alias("n")))
    bucket_bits = max(0, min(20, (own.count() // 2000).bit_length()))
    head = F.conv(F.substring("turn", 1, 8), 16, 10).cast("long")
    own = own.withColumn("bucket", F.shiftright(head, 32 - bucket_bits)).withColumn("key", F.struct("bucket", "turn", "doc_id", "size", "text_hash"))
    by_source = materialize(targets(own.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("source_size")), weights, most))
    told = rounds(own, by_source, most, near).groupBy(F.col("source").alias("s")).agg(F.collect_list(F.struct("low_pass", "low_key", "gap", "high_pass", "high_key", "part")).alias("rounds"))
    about = by_source.join(told, F.col("source").eqNullSafe(F.col("s")), "left").select(F.col("source").alias("s"), "source_size", "target", "place", "rounds")
    placed = own.join(materialize(about), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    passes = [f"t{e}" for e in range(most)]
    placed = materialize(placed.withColumns({t: _times(e) for e, t in enumerate(passes)}).drop("rounds"))
    # Starts are sums of what is taken before, in two steps: over a source's passes and buckets, then within a bucket.
    sums = placed.groupBy("source", "bucket").agg(*(F.sum(F.col(t) * F.col("size")).alias(t) for t in passes))
    each = sums.select("source", "bucket", F.posexplode(F.array(*passes)).alias("e", "words"))
    each = each.withColumn("before", F.sum("words").over(Window.partitionBy("source").orderBy("e", "bucket")) - F.col("words"))
    before = each.groupBy(F.col("source").alias("s"), F.col("bucket").alias("b")).agg(*(F.max(F.when(F.col("e") == e, F.col("before"))).alias(f"b{e}") for e in range(most)))
    placed = placed.join(before, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b"))).drop("s", "b")
    inside = Window.partitionBy("source", "bucket").orderBy("key")
    words = lambda t: F.col(t) * F.col("size")
    parts = [_part(F.lit(0), F.col(t), F.col(f"b{e}") + F.sum(words(t)).over(inside) - words(t)) for e, t in enumerate(passes)]
    placed = placed.withColumn("parts", F.filter(F.array(*parts), lambda x: x.high >= x.low)).withColumn("takes", sum(map(F.col, passes), F.lit(0).cast("long")))
    placed = materialize(placed.select("doc_id", "source", "text_hash", "size", "n", "source_size", "target", "place", "key", "parts", "takes"))
    # What is left of a target goes to the one document that comes nearest to filling it.
    taken = materialize(placed.groupBy(F.col("source").alias("s")).agg(F.sum(F.col("takes") * F.col("size")).alias("taken")))
    gap, size = F.col("target") - F.col("taken"), F.col("size")
    open_ = placed.join(taken, F.col("source").eqNullSafe(F.col("s"))).where((F.col("takes") < most * F.col("n")) & (size > 0) & (F.abs(size - gap) < gap))
    least = F.min(F.struct(F.abs(size - gap).alias("off"), F.struct("key.turn", "key.doc_id", "key.size", "key.text_hash").alias("order"), F.col("key"), F.col("taken").alias("start")))
    fill = materialize(open_.groupBy("source").agg(least.alias("fill")).select(F.col("source").alias("s"), "fill"))
    placed = placed.join(fill, F.col("source").eqNullSafe(F.col("s")) & (F.col("key") == F.col("fill.key")), "left")
    filled = F.col("fill").isNotNull()
    parts = F.when(filled, F.concat("parts", F.array(_part(F.col("takes") % F.col("n"), F.lit(1), F.col("fill.start"))))).otherwise(F.col("parts"))
    placed = placed.withColumn("parts", parts).withColumn("takes", F.col("takes") + filled.cast("long"))
    positions = F.transform("parts", lambda x: _at(x.start, schedules))
    return placed.select("doc_id", "source", "text_hash", "size", "n", "source_size", "target", "place", "takes", "parts", positions.alias("positions"))


def rounds(own: DataFrame, by_source: DataFrame, most: int, near: float) -> DataFrame:
    """What each round takes of a source: rows between two places in the order that are no larger than its gap.

    ``(source, low_pass, low_key, gap, high_pass, high_key, part)``; of the rows alike at the high place, where one
    did not fit, ``part`` are taken. A round takes all that comes before the first that does not fit; that one is larger than
    what the round leaves, so that few rounds follow. A round reads sums by bucket, and the rows of one
    bucket of each source.
    """
    kind = own.schema["key"].dataType
    size, mass = F.col("size"), F.col("n") * F.col("size")
    state = by_source.where("target > 0").select(
        "source", "target", F.lit(0).cast("long").alias("taken"), F.lit(0).alias("low_pass"), F.lit(None).cast(kind).alias("low_key")
    )
    done: DataFrame | None = None
    while True:
        live = state.withColumn("gap", F.col("target") - F.col("taken"))
        here = F.col("low_key").isNull() | (F.col("key") > F.col("low_key"))
        held = own.join(live.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).where((size > 0) & (size <= F.col("gap"))).withColumn("here", here)
        sums = held.groupBy("source", "bucket", "low_pass", "gap").agg(F.sum(F.when(F.col("here"), mass).otherwise(0)).alias("now"), F.sum(mass).alias("whole"))
        each = sums.withColumn("e", F.explode(F.sequence("low_pass", F.lit(most - 1)))).withColumn("words", F.when(F.col("e") == F.col("low_pass"), F.col("now")).otherwise(F.col("whole")))
        each = each.withColumn("end", F.sum("words").over(Window.partitionBy("source").orderBy("e", "bucket")))
        at = each.where((F.col("end") > F.col("gap")) & (F.col("end") - F.col("words") <= F.col("gap"))).select(F.col("source").alias("s2"), "e", F.col("bucket").alias("b"), (F.col("end") - F.col("words")).alias("before"))
        near_by = held.join(at, F.col("source").eqNullSafe(F.col("s2")) & (F.col("bucket") == F.col("b"))).where((F.col("e") > F.col("low_pass")) | F.col("here"))
        near_by = near_by.withColumn("end", F.col("before") + F.sum(mass).over(Window.partitionBy("source").orderBy("key")))
        over = near_by.where((F.col("end") > F.col("gap")) & (F.col("end") - mass <= F.col("gap")))
        part = F.floor((F.col("gap") - (F.col("end") - mass)) / size)
        over = over.select(F.col("source").alias("s3"), F.col("e").alias("high_pass"), F.col("key").alias("high_key"), part.alias("part"), (F.col("end") - mass + part * size).alias("more"))
        got = live.join(over, F.col("source").eqNullSafe(F.col("s3")), "left").select(
            "source", "target", "taken", "low_pass", "low_key", "gap", F.coalesce("high_pass", F.lit(most)).alias("high_pass"), "high_key", F.coalesce("part", F.lit(0).cast("long")).alias("part"), "more"
        )
        got = materialize(got)
        done = got if done is None else done.unionByName(got)
        state = got.where("high_key is not null").select("source", "target", (F.col("taken") + F.col("more")).alias("taken"), F.col("high_pass").alias("low_pass"), F.col("high_key").alias("low_key"))
        state = state.where(F.col("target") - F.col("taken") > F.lit(near) * F.col("target"))
        if state.isEmpty():
            return done.drop("target", "taken", "more")


def _times(e: int) -> Column:
    """How many of the rows alike are taken in pass ``e``."""
    key, n = F.col("key"), F.col("n")

    def of(r: Column) -> Column:
        after = (r.low_pass < e) | ((r.low_pass == e) & (r.low_key.isNull() | (key > r.low_key)))
        before = (r.high_pass > e) | ((r.high_pass == e) & (key < r.high_key))
        last = F.coalesce((r.high_pass == e) & (key == r.high_key), F.lit(False))
        return F.when(last, r.part).when(after & before & (F.col("size") <= r.gap), n).otherwise(0).cast("long")

    taken = F.aggregate(F.coalesce("rounds", F.array().cast(_ROUNDS)), F.lit(0).cast("long"), lambda a, r: a + of(r))
    return F.when(F.col("size") > 0, taken).otherwise(0).cast("long")


_KEY = "struct<bucket:bigint,turn:string,doc_id:bigint,size:bigint,text_hash:bigint>"
_ROUNDS = f"array<struct<low_pass:int,low_key:{_KEY},gap:double,high_pass:int,high_key:{_KEY},part:bigint>>"


def _at(o: Column, schedules) -> Column:
    share = F.coalesce(F.try_divide(o, F.col("target")), F.lit(0.0))
    out = position(share, schedules[-1])
    for i, s in enumerate(schedules[:-1]):
        out = F.when(F.col("place") % len(schedules) == i, position(share, s)).otherwise(out)
    return out


def _part(after: Column, rows: Column, start: Column) -> Column:
    after = after.cast("long")
    return F.struct((after + 1).alias("low"), (after + rows).alias("high"), start.cast("long").alias("start"))


def _copies(row: Column, schedules) -> Column:
    """Positions of the copies of one of the rows alike."""
    own = F.filter("parts", lambda x: (x.low <= row) & (row <= x.high))
    return F.transform(own, lambda x: _at(x.start + (row - x.low) * F.col("size"), schedules))


def mix_report(docs: DataFrame) -> DataFrame:
    """``(doc_id, size, source_size, target, taken, copies, first_position)`` by row of ``docs``.

    A null text has size 0, a null source is a source of its own and comes last. Repeated rows are
    counted and taken one by one. An empty table gives an empty result. Other columns, of whatever name,
    are not read.
    """
    rows = plan(docs).withColumn("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))))
    rows = rows.withColumn("positions", _copies(F.col("row"), SCHEDULES)).withColumn("copies", F.size("positions"))
    return rows.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies", F.element_at(F.when(F.col("copies") > 0, F.col("positions")), 1).alias("first_position"))


def mixed(docs: DataFrame, weights: Sequence[float] = WEIGHTS, schedules=SCHEDULES, most: int = MOST, position: str | None = None) -> DataFrame:
    """The documents in training order, each as often as the mix takes it, with the columns of ``docs``.

    ``position``: the name of a further column with the training time of each copy, 0 to 1; without it the order is
    only that of partitions and rows. Null and empty texts have no word and are not taken; repeated rows, null ids
    and sources are treated as in ``mix_report``; an empty table gives an empty result.
    """
    order = materialize(
        plan(docs, weights, schedules, most)
        .where("takes > 0")
        .select(F.col("doc_id").alias("__id"), F.col("source").alias("__source"), F.col("text_hash").alias("__hash"), "size", "n", "target", "place", "takes", "parts")
    )
    held = docs.select(F.struct("*").alias("__row"))
    met = held.join(
        order,
        F.col("__row.doc_id").cast("long").eqNullSafe(F.col("__id")) & F.col("__row.source").cast("string").eqNullSafe(F.col("__source")) & (F.xxhash64("__row.text") == F.col("__hash")),
    )
    # Rows alike are told apart only where some are taken more often, which is where a target ends: a few groups of a source.
    alike = F.col("takes") % F.col("n") == 0
    number = F.row_number().over(Window.partitionBy("__id", "__source", "__hash").orderBy(F.xxhash64("__row"))).cast("long")
    each = F.transform(F.filter("parts", lambda x: x.low == 1), lambda x: _at(x.start, schedules))
    even = met.where(alike).select("__row", "__id", F.explode(each).alias("__at"))
    uneven = met.where(~alike).withColumn("__number", number).select("__row", "__id", F.explode(_copies(F.col("__number"), schedules)).alias("__at"))
    copies = even.unionByName(uneven)
    return copies.repartitionByRange("__at", "__id").sortWithinPartitions("__at", "__id").select("__row.*", *([F.col("__at").alias(position)] if position else []))
