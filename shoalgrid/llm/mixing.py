"""Mixing sources to target weights by proportionate-fair scheduling.

The rows of each source, in an order shuffled by hash, are cut into blocks; slot
t of the mix holds one block. While it has blocks left, source i is due w_i / W
of each slot, W being the weights of the sources that still have some; so by
slot t it is due f_i(t) blocks, where all f_i together are t. Its k-th block is
released at floor(t_k) and due at ceil(t_(k+1)), t_k being the time at which
f_i reaches k:

    t_k = sum over j of min(n_j, w_j * k / w_i)        (n_j: blocks of source j)

Weights enter as they are, without rounding. Every slot goes to the released
block with the earliest deadline. No deadline is missed, hence a source is at
any time less than one block away from what it is due, over the whole mix.

The slots are dealt into chunks that are scheduled side by side. A chunk starts
from a state that is found without the chunks before it: ``WARM`` slots ahead,
where every source has sent floor(f_i) blocks, and one more those with the
earliest deadlines, the same scheduler is started and run up to the chunk. A
schedule exists from that state on (by Hall's condition for intervals of slots:
floor(f_i(e)) - floor(f_i(s)) blocks at most must be sent between s and e beyond
those counted as sent), so the scheduler meets every deadline; and after as many
slots as the least weight needs for one block, nothing sent can have been
released too late for the slots it took. The next chunk's start is the end of
this one: deadlines are cut at it. So the chunks fit together exactly.

Native DataFrame and SQL expressions only; a chunk is one fold over its slots.
Rows are numbered in two levels - within (source, hash range), then by sums over
ranges - and the slots of a range's blocks come to it as one array, so no source
lands in one task and rows move once. A chunk has ``CHUNK`` slots, or as many as
the least weight needs for one block, each costing time in the number of
sources: group sources first if there are more than some thousands.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, stored

#: Rows in a block; slots in a chunk, at least.
BLOCK_ROWS, CHUNK = 16, 256
#: Without given weights a source weighs its number of rows to this power.
TEMPERATURE = 0.5
#: A time this near to a whole slot is that slot (doubles resolve times up to ten billion slots finer).
SNAP = 1e-5
#: Slots that a fold collects before it appends them, so that appending doesn't copy all for each.
GROUP = 64


def source_key(column: str) -> Column:
    """Never null: a null source is one of its own."""
    return F.coalesce(F.concat(F.lit("s"), F.col(column).cast("string")), F.lit("null"))


def weighted(counts: DataFrame, weights: dict[str | None, float] | None = None, temperature: float = TEMPERATURE, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(src, n, blocks, w) from (src, n). Sources without a given weight weigh as little as the least given one."""
    if weights is None:
        n = F.col("n").cast("double")
        weight = F.sqrt(n) if temperature == 0.5 else F.pow(n, F.lit(float(temperature)))
    else:
        if not weights or any(not (w > 0) or w == float("inf") for w in weights.values()):
            raise ValueError("weights must be positive and finite")
        named = F.create_map(*[x for k, w in weights.items() for x in (F.lit("null" if k is None else f"s{k}"), F.lit(float(w)))])
        weight = F.coalesce(F.try_element_at(named, F.col("src")), F.lit(float(min(weights.values()))))
    return counts.select("src", "n", F.ceil(F.col("n") / block_rows).cast("long").alias("blocks"), weight.alias("w"))


# The scheduler is SQL text, as it is one deep expression. ``s`` is an array of
# struct(src, blocks, w), one entry for each source; other names are columns.


def _let(name: str, value: str, body: str) -> str:
    """``body``, in which ``name`` stands for ``value``, computed once however often it is named."""
    return f"get(transform(array({value}), {name} -> {body}), 0)"


def _sum(array: str, zero: str = "0D") -> str:
    return f"aggregate({array}, {zero}, (p, q) -> p + q)"


def _time(v: str) -> str:
    """Slots passed when each source has been due w * v blocks."""
    return _sum(f"transform(s, z -> least(double(z.blocks), z.w * ({v})))")


def _released(x: str, k: str) -> str:
    return f"floor({_time(f'{k} / {x}.w')} + {SNAP})"


def _due(x: str, k: str) -> str:
    return f"ceil({_time(f'({k} + 1) / {x}.w')} - {SNAP})"


def opening(at: str) -> str:
    """Blocks that each source has sent at slot ``at``: floor(f_i), and one more for those with the earliest deadlines."""
    # t(v) is concave: the least of its tangents, so v(t) is the largest of their inverses
    past = _sum("transform(s, x -> if(x.blocks / x.w <= u, double(x.blocks), 0D))")
    rate = _sum("transform(s, x -> if(x.blocks / x.w > u, x.w, 0D))")
    knots = f"transform(concat(array(-1D), transform(s, x -> x.blocks / x.w)), u -> struct({past} AS past, {rate} AS rate))"
    clock = f"array_max(transform({knots}, k -> if(k.rate > 0, ({at} - k.past) / k.rate, NULL)))"
    parts = _let("f", "least(double(x.blocks), x.w * v)", f"struct(x AS x, i AS i, f AS f, floor(f + {SNAP}) AS low)")
    spare = f"array_sort(transform(filter(own, y -> y.f - y.low > {SNAP}), y -> struct({_due('y.x', 'y.low')} AS due, y.i AS i)))"
    count = f"greatest(0, int({at} - {_sum('transform(own, y -> y.low)', '0L')}))"
    rounded = _let("more", f"transform(slice({spare}, 1, {count}), y -> y.i)", "transform(own, y -> y.low + bigint(array_contains(more, y.i)))")
    return _let("v", clock, _let("own", f"transform(s, (x, i) -> {parts})", rounded))


def edf(sent: str, end: str, start: str, stop: str, latest: str) -> str:
    """struct(sent, picks): earliest deadline first over the slots start..stop-1.

    ``end``: blocks after which each source stops; ``latest``: no deadline is
    later. ``picks``: (source index, block) by slot, in groups of ``GROUP``.
    """

    def head(x: str, k: str, end: str) -> str:
        """The k-th block of a source as it waits; null if there is none."""
        return f"if({k} < {end}, struct({_released(x, k)} AS released, least({latest}, {_due(x, k)}) AS due), NULL)"

    waiting = "filter(transform(a.head, (h, i) -> if(h IS NULL, NULL, struct(h.released > t AS early, h.due AS due, i AS i))), h -> h IS NOT NULL)"
    heads = f"transform(a.head, (h, i) -> if(i = best, {head('get(s, i)', '(get(a.sent, i) + 1)', f'get({end}, i)')}, h))"
    step = f"struct(transform(a.sent, (k, i) -> if(i = best, k + 1, k)) AS sent, {heads} AS head, concat(a.picks, array(struct(best AS i, get(a.sent, best) AS k))) AS picks)"
    pick = "array<struct<i: int, k: bigint>>"
    slots = f"aggregate(sequence(first, least(first + {GROUP}, {stop}) - 1), struct(b.sent AS sent, b.head AS head, cast(array() AS {pick}) AS picks), (a, t) -> {_let('best', f'array_min({waiting}).i', step)})"
    group = _let("d", slots, "struct(d.sent AS sent, d.head AS head, concat(b.picks, array(d.picks)) AS picks)")
    begin = f"struct({sent} AS sent, transform({sent}, (k, i) -> {head('get(s, i)', 'k', f'get({end}, i)')}) AS head, cast(array() AS array<{pick}>) AS picks)"
    firsts = f"if({stop} > {start}, sequence({start}, {stop} - 1, {GROUP}L), cast(array() AS array<bigint>))"
    return f"aggregate({firsts}, {begin}, (b, first) -> {group}, b -> struct(b.sent AS sent, b.picks AS picks))"


def schedule(sources: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(src, k, slot): the k-th block of src has that slot of the mix. ``sources`` has (src, blocks, w)."""
    spark = sources.sparkSession
    blocks, warm = sources.agg(F.coalesce(F.sum("blocks"), F.lit(0)), F.coalesce(F.ceil(F.sum("w") / F.min("w") - 1e-9), F.lit(1))).first()
    length = max(chunk, warm)
    n = -(-blocks // length)
    tasks = max(1, min(n + 1, 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    # one row, with an entry for each source
    listed = F.broadcast(sources.agg(F.array_sort(F.collect_list(F.struct("src", "blocks", "w"))).alias("s"), F.lit(blocks).alias("blocks"), F.lit(length).alias("length")))
    start, full = "least(c * length, blocks)", "transform(s, x -> x.blocks)"
    # at both ends of the mix the state is known
    state = f"CASE WHEN c = {n} THEN {full} WHEN c = 0 THEN transform(s, x -> 0L) ELSE {edf('ahead', 'full', 'since', 'start', 'blocks')}.sent END"
    chunks = spark.range(0, n + 1, 1, tasks).withColumnRenamed("id", "c").join(listed).selectExpr("*", f"{start} AS start", f"{full} AS full")
    chunks = chunks.selectExpr("*", f"greatest(0L, start - {warm}) AS since").selectExpr("*", f"{opening('since')} AS ahead")
    states = stored(chunks.selectExpr("c", f"{state} AS sent"), "mix-states")
    ends = states.selectExpr("c - 1 AS c", "sent AS `end`")
    todo = spark.range(0, n, 1, tasks).withColumnRenamed("id", "c").join(states, "c").join(ends, "c").join(listed)
    todo = todo.selectExpr("s", "sent", "`end`", f"{start} AS start", "least((c + 1) * length, blocks) AS stop")
    done = todo.selectExpr("s", "start", f"flatten({edf('sent', '`end`', 'start', 'stop', 'stop')}.picks) AS picks")
    return done.selectExpr("s", "start", "posexplode(picks) AS (nth, p)").selectExpr("get(s, p.i).src AS src", "p.k AS k", "start + nth AS slot")


def mix(df: DataFrame, source: str = "source", id_column: str = "doc_id", weights: dict[str | None, float] | None = None, block_rows: int = BLOCK_ROWS, chunk: int = CHUNK, prefix: str = "mix_") -> DataFrame:
    """``df`` with its place in the mix: ``prefix`` + rank (in the source, from 0), block (slot of the mix) and position (orders the rows).

    Every row is kept. Within a source rows are ordered by the MD5 of their id
    (null ids first), ties by the row's other columns; rows equal in all take
    adjacent places. Rows with a null id are dealt over ranges of their own by
    the hash of their columns. Null is a source of its own. The last block of a
    source may be short, so positions leave gaps. An empty table gives no rows.
    """
    spark = df.sparkSession
    ranges = max(2, 2 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    names = [f"`{c}`" for c in df.columns]
    ordered = [c for c, (_, kind) in zip(names, df.dtypes) if "map<" not in kind and "variant" not in kind]
    hashed = F.md5(F.col(f"`{id_column}`").cast("string").cast("binary"))
    loose = F.pmod(F.xxhash64(*ordered), F.lit(ranges)) - ranges  # ranges below zero: null ids come first
    part = F.when(hashed.isNull(), loose).otherwise(F.floor(F.conv(F.substring(hashed, 1, 8), 16, 10).cast("long") * ranges / (1 << 32))).cast("long")
    # the row travels as one struct, so that its columns can't clash with those made here
    packed = F.struct(*[F.col(c) for c in names]).alias("_row")
    rows = df.select(packed, source_key(f"`{source}`").alias("_src"), F.coalesce(hashed, F.lit("")).alias("_hash"), part.alias("_range"))
    counts = stored(rows.groupBy("_src", "_range").agg(F.count("*").alias("n")), "mix-counts")
    before = Window.partitionBy("_src").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    sources = stored(weighted(counts.groupBy(F.col("_src").alias("src")).agg(F.sum("n").alias("n")), weights, block_rows=block_rows), "mix-sources")
    plan = schedule(sources, chunk).select(F.col("src").alias("_src"), "k", "slot")
    # the slots of the blocks that a range's rows lie in, in order: one array for each range
    first = F.floor(F.col("_before") / block_rows)
    held = offsets.withColumn("k", F.explode(F.sequence(first, F.floor((F.col("_before") + F.col("n") - 1) / block_rows)))).join(plan, ["_src", "k"])
    held = held.groupBy("_src", "_range").agg(F.first("_before").alias("_before"), F.transform(F.array_sort(F.collect_list(F.struct("k", "slot"))), lambda x: x["slot"]).alias("_slots"))
    held = stored(held, "mix-slots")
    inner = Window.partitionBy("_src", "_range").orderBy("_hash", *[F.col(f"_row.{c}") for c in ordered])
    placed = rows.withColumn("_nth", F.row_number().over(inner)).join(held, ["_src", "_range"])
    rank = (F.col("_before") + F.col("_nth") - 1).cast("long")
    placed = placed.withColumn("_rank", rank).withColumn("_block", F.get("_slots", (F.floor(F.col("_rank") / block_rows) - F.floor(F.col("_before") / block_rows)).cast("int")))
    keep = [F.col(f"_row.{c}").alias(raw) for c, raw in zip(names, df.columns) if raw not in (f"{prefix}rank", f"{prefix}block", f"{prefix}position")]
    return placed.select(*keep, F.col("_rank").alias(f"{prefix}rank"), F.col("_block").alias(f"{prefix}block"), (F.col("_block") * block_rows + F.col("_rank") % block_rows).alias(f"{prefix}position"))


def mixed(df: DataFrame, source: str = "source", id_column: str = "doc_id", weights: dict[str | None, float] | None = None) -> DataFrame:
    """The rows of ``df`` in the order of the mix, columns unchanged: partition after partition, sorted within.

    The order is that of the files when written; a reader need not keep it, but
    ``mix`` over the rows read gives each its place again.
    """
    place = fresh(df, "_mix_")
    out = mix(df, source, id_column, weights, prefix=place)
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return out.repartitionByRange(n, f"{place}position").sortWithinPartitions(f"{place}position").select(*[F.col(f"`{c}`") for c in df.columns])
