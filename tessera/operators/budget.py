"""Ordered budgets: state that depends on every earlier decision of a group. Small groups stream through one task; large ones are cut into blocks."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, LongType, StringType, StructField, StructType

from tessera.sources.shared import saved

BLOCK = 1 << 16  # rows of a group that one task decides one after another
UNLIMITED = 1 << 62
MOST_NAMED = 1000  # blocks that a filter names; of more, the join alone tells
_LEVELS = StructType([StructField("kind", StringType()), StructField("small", ArrayType(LongType())), StructField("mid", ArrayType(LongType()))])


def _columns(batch: pa.RecordBatch, *names: str) -> list[list]:
    return [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in names]


def _with(batch: pa.RecordBatch, **new: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*batch.columns, *new.values()], [*batch.schema.names, *new])


def _spender(budgets: dict | int, idle_stop: int | None):
    """Streams sorted rows: a group's state is what each kind has left, how many tasks in a row added nothing, and whether its phase has ended."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, left, idle, stopped, phase = None, {}, 0, False, None
        for batch in batches:
            taken = []
            for group, kind, part, n in zip(*_columns(batch, "_group", "_kind", "_phase", "_cost")):
                if group != at:
                    at, left, phase = group, {}, None
                if part != phase:
                    phase, idle, stopped = part, 0, False
                room = left.setdefault(kind, budgets if isinstance(budgets, int) else budgets.get(kind, 0))
                ok = not stopped and room > 0 and n is not None and 0 <= n <= room
                left[kind] = room - n if ok else room
                idle = 0 if ok and n > 0 else idle + 1
                stopped = stopped or (part == 1 and idle_stop is not None and room <= 0 and idle >= idle_stop)
                taken.append(ok)
            yield _with(batch, taken=pa.array(taken, pa.bool_()))

    return of


def _spent(costs: np.ndarray, room: int) -> tuple[np.ndarray, int, int]:
    """What room takes of costs (-1: never), what is left, and from which row on nothing was left.

    While room lies in [2^k, 2^(k+1)), all costs below 2^k fit. So a running sum of these tells where room falls below
    2^k, and of the costs from 2^k on at most one is taken, after which it has. Each step thus ends a power of two.
    """
    taken, at, empty = np.zeros(len(costs), bool), 0, 0 if room <= 0 else len(costs)
    while at < len(costs) and room > 0:
        k = int(room).bit_length() - 1
        rest = costs[at:]
        small = (rest >= 0) & (rest < 1 << k)
        run = np.cumsum(np.where(small, rest, 0))
        fits = ~small & (rest >= 0) & (rest <= room - run)
        end = fits | (small & (room - run < 1 << k))
        last = int(np.argmax(end)) if end.any() else len(rest) - 1
        taken[at : at + last + 1] = small[: last + 1]
        room -= int(run[last])
        if fits[last]:
            taken[at + last] = True
            room -= int(rest[last])
        at += last + 1
        if room <= 0:
            empty = at
    return taken, room, empty


def _levels(costs: np.ndarray) -> tuple[list[int], list[int]]:
    """A block for any room it may be entered with, by that room's power of two k: the sum of costs below 2^k, and the
    least that room must be for a cost of that power to be taken before room falls below 2^k (UNLIMITED: there is none)."""
    small, mid = [], []
    for k in range(int(costs.max(initial=0)).bit_length() + 1):
        low = (costs >= 0) & (costs < 1 << k)
        run = np.cumsum(np.where(low, costs, 0))
        same = ~low & (costs >= 0) & (costs < 1 << (k + 1))
        small.append(int(run[-1]) if len(run) else 0)
        mid.append(int((run + costs)[same].min(initial=UNLIMITED)))
    return small, mid


def _through(room: int, small: list[int], mid: list[int]) -> int | None:
    """What a block leaves of room, None where room falls below its power of two inside and the block's rows must tell."""
    if room <= 0:
        return room
    k = room.bit_length() - 1
    if k >= len(small):  # all costs are below 2^k
        k, spent, least = len(small) - 1, small[-1], UNLIMITED
        return room - spent if room - spent >= 1 << k else None
    spent, least = small[k], mid[k]
    return room - spent if room - spent >= 1 << k and least > room else None


def _cut(block: int):
    """Numbers sorted rows: _block goes up where a group begins and after so many rows; its last row carries the levels of its kinds."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        number, size, at = 0, 0, None

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal number, held, size
            rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            kinds, costs = _columns(rows, "_kind", "_cost")
            costs = np.array([-1 if c is None or c < 0 else c for c in costs], np.int64)
            kinds = np.array(kinds, object)
            levels = [dict(zip(("kind", "small", "mid"), (k, *_levels(costs[kinds == k])))) for k in sorted(set(kinds))]
            of_rows = [None] * (rows.num_rows - 1) + [levels]
            kind = pa.list_(pa.struct([("kind", pa.string()), ("small", pa.list_(pa.int64())), ("mid", pa.list_(pa.int64()))]))
            yield _with(rows, _block=pa.array([number] * rows.num_rows, pa.int32()), _pos=pa.array(range(rows.num_rows), pa.int32()), _levels=pa.array(of_rows, kind))
            number, held, size = number + 1, [], 0

        for batch in batches:
            groups, first = _columns(batch, "_group")[0], 0
            while first < len(groups):
                if size and (groups[first] != at or size >= block):
                    yield from flush()
                at, last = groups[first], first
                while last < len(groups) and groups[last] == at and size + last - first < block:
                    last += 1
                held.append(batch.slice(first, last - first))
                size, first = size + last - first, last
        if size:
            yield from flush()

    return of


def _walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of lanes (a group's kind) in order, to what each is entered with. A lane ends at the first block whose rows must tell and didn't yet."""
    lane, room = None, 0
    for batch in batches:
        out: list[tuple] = []
        for group, kind, part, block, small, mid, start, left in zip(*_columns(batch, "_group", "_kind", "_part", "_block", "small", "mid", "start", "left")):
            if (group, kind) != lane:
                lane, room = (group, kind), start
            if room is None:
                continue
            after = left if left is not None else _through(room, small, mid)
            out.append((part, block, kind, room, after is None))
            room = after
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 5, (pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.bool_()))], ["_part", "_block", "_kind", "entry", "pending"])


def _left(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by block, kind and place to what each block leaves of its entry."""
    rows = (r for b in batches for r in zip(*_columns(b, "_part", "_block", "_kind", "_cost", "entry")))
    for (part, block, kind), own in groupby(rows, lambda r: r[:3]):
        own = list(own)
        left = _spent(np.array([-1 if r[3] is None or r[3] < 0 else r[3] for r in own], np.int64), own[0][4])[1]
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([block], pa.int32()), pa.array([kind]), pa.array([left], pa.int64())], ["_part", "_block", "_kind", "left"])


def _decided(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by block and place, with what their kind entered the block with, to rows with taken and what tells an idle stop:
    _idle, tasks in a row up to this one that added nothing, as far as the block tells; _open, nothing was added in it yet; _empty, nothing was left."""

    def one(rows: pa.RecordBatch) -> pa.RecordBatch:
        kinds, costs, entries = _columns(rows, "_kind", "_cost", "entry")
        costs, kinds = np.array([-1 if c is None or c < 0 else c for c in costs], np.int64), np.array(kinds, object)
        taken, empty = np.zeros(len(costs), bool), np.zeros(len(costs), bool)
        for k in set(kinds):
            own = np.flatnonzero(kinds == k)
            taken[own], _, from_ = _spent(costs[own], entries[own[0]])
            empty[own[from_:]] = True
        place = np.arange(len(costs))
        last = np.maximum.accumulate(np.where(taken & (costs > 0), place, -1))
        return _with(rows, taken=pa.array(taken), _idle=pa.array(place - last, pa.int64()), _open=pa.array(last < 0), _empty=pa.array(empty))

    held: list[pa.RecordBatch] = []
    at = None
    for batch in batches:
        keys, first = list(zip(*_columns(batch, "_part", "_block"))), 0
        while first < len(keys):
            if held and keys[first] != at:
                yield one(pa.Table.from_batches(held).combine_chunks().to_batches()[0])
                held = []
            at, last = keys[first], first
            while last < len(keys) and keys[last] == at:
                last += 1
            held.append(batch.slice(first, last - first))
            first = last
    if held:
        yield one(pa.Table.from_batches(held).combine_chunks().to_batches()[0])


def _blockwise(rows: DataFrame, order: list[str], starts: DataFrame, idle_stop: int | None, block: int) -> DataFrame:
    """rows with taken, for groups of any size. starts: what each _group and _kind begins with.

    Rows are dealt by ranges of group and order, so no task holds a group, and cut into blocks. A block is summed up by
    levels, two numbers for each power of two up to its largest cost; one walk over these (a row a block) carries room
    from block to block. Only where room falls below a power of two are a block's rows asked, which happens at most as
    often as room has bits. With the rooms known, all blocks are decided at once. An idle stop changes nothing before
    it, so it is found afterwards, from each block's tail and its place.
    """
    ranged = rows.repartitionByRange("_group", *order).sortWithinPartitions("_group", *order)
    ints = [StructField("_block", IntegerType()), StructField("_pos", IntegerType()), StructField("_levels", ArrayType(_LEVELS))]
    dealt = ranged.withColumn("_part", F.spark_partition_id())
    placed = saved(dealt.mapInArrow(_cut(block), StructType([*dealt.schema.fields, *ints])), "blocks")
    block_of = ["_part", "_block"]
    levels = placed.filter("_levels is not null").select("_group", *block_of, F.explode("_levels").alias("x")).select("_group", F.col("x.kind").alias("_kind"), *block_of, "x.small", "x.mid")
    levels = saved(levels.join(starts.withColumnRenamed("room", "start"), ["_group", "_kind"]), "levels")
    found: list[DataFrame] = []
    while True:
        known = reduce(DataFrame.union, found) if found else rows.sparkSession.createDataFrame([], "_part int, _block int, _kind string, left bigint")
        walk = levels.join(known, [*block_of, "_kind"], "left").repartition("_group", "_kind").sortWithinPartitions("_group", "_kind", *block_of)
        entries = saved(walk.mapInArrow(_walked, "_part int, _block int, _kind string, entry bigint, pending boolean"), "entries")
        pending = entries.filter("pending").drop("pending")
        which = pending.select(*block_of).distinct().limit(MOST_NAMED + 1).collect()
        if not which:
            break
        near = placed if len(which) > MOST_NAMED else placed.filter(F.col("_part").isin(sorted({r[0] for r in which})) & F.col("_block").isin(sorted({r[1] for r in which})))  # other files are not read
        asked = near.select(*block_of, "_kind", "_pos", "_cost").join(pending, [*block_of, "_kind"])
        asked = asked.repartition(*block_of, "_kind").sortWithinPartitions(*block_of, "_kind", "_pos").select(*block_of, "_kind", "_cost", "entry")
        found.append(saved(asked.mapInArrow(_left, "_part int, _block int, _kind string, left bigint"), "left"))
    entered = placed.drop("_levels").join(entries.drop("pending"), [*block_of, "_kind"]).repartition(*block_of).sortWithinPartitions(*block_of, "_pos")
    more = [StructField("taken", BooleanType()), StructField("_idle", LongType()), StructField("_open", BooleanType()), StructField("_empty", BooleanType())]
    decided = entered.mapInArrow(_decided, StructType([*entered.schema.fields, *more]))
    if idle_stop is None:
        return decided
    decided = saved(decided, "decided")
    tails = decided.groupBy("_group", *block_of).agg(F.max_by(F.struct("_idle", "_open"), "_pos").alias("tail"))
    before = Window.partitionBy("_group").orderBy(*block_of).rowsBetween(Window.unboundedPreceding, -1)
    # rows of a block before its first addition go on with the count of the blocks before, back to the last addition in one
    sums = tails.withColumn("run", F.sum(F.when(F.col("tail._open"), F.col("tail._idle")).otherwise(0)).over(before)).withColumn("since", F.last(F.when(~F.col("tail._open"), F.struct(F.col("tail._idle").alias("idle"), (F.coalesce("run", F.lit(0))).alias("run"))), ignorenulls=True).over(before))
    carried = sums.select("_group", *block_of, F.coalesce(F.col("run") - F.coalesce(F.col("since.run"), F.lit(0)) + F.coalesce(F.col("since.idle"), F.lit(0)), F.lit(0)).alias("carried"))
    carried = saved(carried, "carried")
    stops = decided.filter("_empty").join(carried.drop("_group"), block_of).filter(F.col("_idle") + F.when(F.col("_open"), F.col("carried")).otherwise(0) >= idle_stop)
    first = stops.groupBy("_group").agg(F.min(F.struct(*block_of, "_pos")).alias("stop"))
    ends = saved(carried.join(first, "_group").select(*block_of, F.when(F.struct(*block_of) < F.struct("stop._part", "stop._block"), F.lit(None)).when((F.col("_part") == F.col("stop._part")) & (F.col("_block") == F.col("stop._block")), F.col("stop._pos")).otherwise(-1).alias("end")).filter("end is not null"), "ends")
    return decided.join(ends, block_of, "left").withColumn("taken", F.col("taken") & F.coalesce(F.col("_pos") <= F.col("end"), F.lit(True)))


def greedy(tasks: DataFrame, group: list[str], order: list[str], cost: str, budget: int | dict[str, int | None], idle_stop: int | None = None, kind: str | None = None, phase: str | None = None, block: int = BLOCK) -> DataFrame:
    """tasks with taken: a task is taken iff its cost still fits what its group (and kind) has left, else skipped and the next tried.

    budget: one for all kinds, or one a kind (None: without a limit; kinds that aren't named have none to spend).
    idle_stop: a task that adds nothing counts, one that adds resets the count; a group ends at a task whose budget is
    already spent once so many in a row have added nothing. phase (1 or 2): tasks of phase 1 come first, and an idle
    stop ends phase 1 alone, over all its kinds; phase 2 goes on with what is left.
    Costs are whole numbers; null and negative ones are never taken. order tells rows of a group apart; nulls sort
    first. Groups of up to block rows are hashed to tasks and stream by there; larger ones are cut into blocks that
    tasks decide side by side, see _blockwise. A null group or kind is one of its own. An empty table gives an empty result.
    """
    budgets = budget if isinstance(budget, int) else {k: UNLIMITED if v is None else v for k, v in budget.items()}
    own = F.to_json(F.struct(*group), {"ignoreNullFields": "false"}) if group else F.lit("")
    rows = tasks.select("*", own.alias("_group"), (F.coalesce(F.col(kind).cast("string"), F.lit("")) if kind else F.lit("")).alias("_kind"), (F.col(phase) if phase else F.lit(1)).cast("int").alias("_phase"), F.col(cost).cast("long").alias("_cost"))
    order = ["_phase", *order] if phase else order
    large = rows.groupBy("_group").agg(F.count("*").alias("_n")).filter(F.col("_n") > block).select("_group")
    large = saved(large, "large")
    some = large.isEmpty()
    small = rows if some else rows.join(large, "_group", "left_anti")
    dealt = small.repartition("_group").sortWithinPartitions("_group", *order)
    out = dealt.mapInArrow(_spender(budgets, idle_stop), StructType([*dealt.schema.fields, StructField("taken", BooleanType())])).select(*tasks.columns, "taken")
    if some:
        return out
    cut = rows.join(large, "_group", "left_semi")
    room = F.lit(budgets) if isinstance(budgets, int) else F.coalesce(F.create_map(*(F.lit(x) for kv in budgets.items() for x in kv))[F.col("_kind")], F.lit(0))
    starts = cut.select("_group", "_kind").distinct().withColumn("room", room.cast("long"))
    one = _blockwise(cut.filter("_phase = 1"), order, starts, idle_stop, block)
    if phase:
        one = saved(one.select(*rows.columns, "taken"), "phase")
        paid = one.filter("taken").groupBy("_group", "_kind").agg(F.sum("_cost").alias("paid"))
        rest = starts.join(paid, ["_group", "_kind"], "left").select("_group", "_kind", (F.col("room") - F.coalesce("paid", F.lit(0))).alias("room"))
        one = one.select(*tasks.columns, "taken").union(_blockwise(cut.filter("_phase = 2"), order, rest, None, block).select(*tasks.columns, "taken"))
    return out.union(one.select(*tasks.columns, "taken"))


def two_phase(tasks: DataFrame, group: list[str], kind: str, phase: str, order: list[str], cost: str, budget: int | dict[str, int | None], filler: str = "real", idle_stop: int | None = None, block: int = BLOCK) -> DataFrame:
    """greedy with a budget for each kind of a group; phase 2 comes after phase 1 and only fills what filler has left. An idle stop ends phase 1."""
    return greedy(tasks.filter((F.col(phase) == 1) | (F.col(kind) == filler)), group, order, cost, budget, idle_stop, kind, phase, block)


def ema(values: DataFrame, group: str, order: list[str], value: str, alpha: float = 0.25) -> DataFrame:
    """Per group: the count, the mean, and the exponential average that begins with the first value.

    The average is a weighted sum: a value k places before the last weighs alpha * (1 - alpha) ** k, the first one
    (1 - alpha) ** k. Ranks stream over sorted rows, and the sum is combined before it is shuffled.
    """
    back = F.row_number().over(Window.partitionBy(group).orderBy(*(F.desc(c) for c in order))) - 1
    placed = values.select(group, F.col(value).cast("double").alias("v"), back.alias("k"))
    weighed = F.col("v") * F.pow(F.lit(1 - alpha), F.col("k"))
    total = placed.groupBy(group).agg(F.count("*").alias("n"), F.avg("v").alias("mean"), F.sum(weighed * alpha).alias("s"), F.max_by(weighed * (1 - alpha), "k").alias("first"))
    return total.select(group, "n", F.round("mean", 6).alias("mean"), F.round(F.col("s") + F.col("first"), 6).alias("ema"))
