"""Transfers: speed, remaining time, throughput trends, retries, resumable prefixes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mediacat.functions.conditions import let
from mediacat.functions.numbers import chunk_size
from mediacat.operators.dispatch import is_retryable
from mediacat.operators.ordered import Running, explode_range, number_rows, running

# Seconds between accepted samples, seconds of the rate window, weight of the newest rate, the
# share below which no time is estimated, samples of the throughput average, drops that count.
GATE_SECONDS = 0.05
WINDOW_SECONDS = 3.0
NEW_WEIGHT = 0.3
WARMUP_SHARE = 0.005
HISTORY = 8
DROP_SHARE = 0.30
HOLD_SHARE = 0.10
RETRY_SHARE = 10


#: Seconds of a block of samples, and blocks of a run of them.
BLOCK_SECONDS, RUN_BLOCKS = 15, 512
_GATE, _WINDOW, _BLOCK = int(GATE_SECONDS * 1e6), int(WINDOW_SECONDS * 1e6), BLOCK_SECONDS * 1_000_000
#: Accepted samples that a rate window can hold besides the last.
_MOST = _WINDOW // _GATE
_NEVER = (1 << 63) - 1


def carried(
    blocks: DataFrame, by: str, apply: Callable[[Column, Column], Column], compose: Callable[[Column], Column], kind: str
) -> DataFrame:
    """The state before each block: rows ``by, _b, _state`` from rows ``by, _b, _s``.

    ``_s`` says what a block makes of a state, ``apply`` does it, and ``compose`` makes one such value of an ordered array
    of structs with ``s``. Blocks are composed by runs of ``RUN_BLOCKS`` in tasks of their own; only runs, a row for some
    hours of a transfer, are walked through in order, and the blocks of a run again from the state before it.
    """
    run = F.floor(F.col("_b") / RUN_BLOCKS)
    runs = blocks.groupBy(by, run.alias("_run")).agg(F.sort_array(F.collect_list(F.struct(F.col("_b").alias("b"), F.col("_s").alias("s")))).alias("_l"))

    def walk(items: Column, state: Column, place: str) -> Column:
        """The state before each item."""
        start = F.struct(state.alias("state"), F.array().cast(f"array<struct<{place}:bigint,state:{kind}>>").alias("out"))
        step = lambda acc, x: F.struct(apply(x["s"], acc["state"]).alias("state"), F.concat(acc["out"], F.array(F.struct(x[place].cast("long").alias(place), acc["state"].alias("state")))).alias("out"))
        return F.aggregate(items, start, step, lambda acc: acc["out"])

    none = F.lit(None).cast(kind)
    whole = runs.select(by, F.struct(F.col("_run").alias("run"), compose(F.col("_l")).alias("s")).alias("_x"))
    ordered = whole.groupBy(by).agg(F.sort_array(F.collect_list("_x")).alias("_x"))
    before = ordered.select(by, F.explode(walk(F.col("_x"), none, "run")).alias("_y")).select(by, F.col("_y.run").alias("_run"), F.col("_y.state").alias("_before"))
    walked = runs.join(before, [by, "_run"]).select(by, F.explode(walk(F.col("_l"), F.col("_before"), "b")).alias("_y"))
    return walked.select(by, F.col("_y.b").alias("_b"), F.col("_y.state").alias("_state"))


def _next_accepted(last: Column, at: Column) -> Column:
    return F.when(last.isNull() | (at >= last + _GATE), at).otherwise(last)


def _through_table(table: Column, last: Column) -> Column:
    """The last accepted sample after a block, given that before it."""
    fits = F.filter(table, lambda t: last.isNull() | (t["entry"] >= last + _GATE))
    return F.coalesce(F.get(fits, 0)["exit"], last)


def _gate_table(times: Column, block: Column) -> Column:
    """For each sample that may be the first accepted one of a block: the last accepted one.

    What was accepted before the block lies before its start, so that the first is one of those in the first gate's width,
    or the one after them.
    """
    limit = block * _BLOCK + _GATE
    entries = F.filter(times, lambda x, i: (x < limit) | (i == 0) | (F.get(times, i - 1) < limit))
    return F.transform(entries, lambda e: F.struct(e.alias("entry"), F.aggregate(times, e, _next_accepted).alias("exit")))


def _gate_tables(items: Column) -> Column:
    """The table of a run of blocks; if no sample of the first is accepted, the others start anew, as they lie far behind."""
    rest = F.slice(items, F.lit(2), F.greatest(F.size(items) - 1, F.lit(0)))
    onward = lambda last: F.aggregate(rest, last, lambda acc, x: _through_table(x["s"], acc))
    first = F.transform(F.get(items, 0)["s"], lambda t: F.struct(t["entry"].alias("entry"), onward(t["exit"]).alias("exit")))
    return F.concat(first, F.array(F.struct(F.lit(_NEVER).alias("entry"), onward(F.lit(None).cast("long")).alias("exit"))))


def _smoothed(average: Column, rate: Column) -> Column:
    return F.when(rate.isNull(), None).when(average.isNull(), rate).otherwise(NEW_WEIGHT * rate + (1.0 - NEW_WEIGHT) * average)


def _average_of(rates: Column) -> Column:
    """What a block makes of the average before it: ``anew`` if that is unknown or a rate is missing, else linear in it."""
    none = F.lit(None).cast("double")
    return F.struct(
        F.exists(rates, lambda r: r.isNull()).alias("resets"),
        F.aggregate(rates, none, _smoothed).alias("anew"),
        F.pow(F.lit(1.0 - NEW_WEIGHT), F.size(rates)).alias("factor"),
        F.coalesce(F.aggregate(rates, F.lit(0.0).cast("double"), _smoothed), F.lit(0.0)).alias("part"),
    )


def _after(s: Column, average: Column) -> Column:
    return F.when(s["resets"] | average.isNull(), s["anew"]).otherwise(s["factor"] * average + s["part"])


def _average_of_run(items: Column) -> Column:
    onward = lambda average: F.aggregate(items, average, lambda acc, x: _after(x["s"], acc))
    return F.struct(
        F.exists(items, lambda x: x["s"]["resets"]).alias("resets"),
        onward(F.lit(None).cast("double")).alias("anew"),
        F.aggregate(items, F.lit(1.0).cast("double"), lambda acc, x: acc * x["s"]["factor"]).alias("factor"),
        F.coalesce(onward(F.lit(0.0).cast("double")), F.lit(0.0)).alias("part"),
    )


def speed_meter(progress: DataFrame, by: str = "transfer_id", tie: str = "event_id") -> DataFrame:
    """The smoothed rate after every sample (bytes per second).

    Which samples the gate accepts depends on the last accepted one, and an average on all former ones. A transfer is cut
    into blocks of ``BLOCK_SECONDS``; a block becomes a table from the sample that is accepted first to the one accepted
    last, blocks compose by looking up one table's result in the next, and each block is then read once from the sample it
    starts with. Rates take up the accepted samples of the block before; averages compose as linear functions. So a
    transfer without pauses, of any number of samples, is spread over tasks.
    """
    us = F.unix_micros("ts")
    sample = F.struct(us.alias("us"), F.col(tie).alias("tie"), F.col("cumulative_bytes").cast("double").alias("total"))
    blocks = progress.groupBy(by, F.floor(us / _BLOCK).alias("_b")).agg(F.sort_array(F.collect_list(sample)).alias("_samples"))
    # Arrays that lambdas look into are bound: a column of a former projection may be moved into the lambda and made anew.
    times = F.transform("_samples", lambda x: x["us"])
    tables = blocks.select(by, "_b", let(times, lambda t: _gate_table(t, F.col("_b"))).alias("_s"))
    entered = blocks.join(carried(tables, by, _through_table, _gate_tables, "bigint"), [by, "_b"])

    kept = "array<struct<us:bigint,tie:bigint,total:double>>"
    start = F.struct(F.col("_state").alias("last"), F.array().cast(kept).alias("kept"))

    def step(acc: Column, x: Column) -> Column:
        ok = acc["last"].isNull() | (x["us"] >= acc["last"] + _GATE)
        one = F.struct(x["us"].alias("us"), x["tie"].cast("long").alias("tie"), x["total"].alias("total"))
        return F.struct(F.when(ok, x["us"]).otherwise(acc["last"]).alias("last"), F.when(ok, F.concat(acc["kept"], F.array(one))).otherwise(acc["kept"]).alias("kept"))

    accepted = entered.select(by, "_b", "_samples", F.aggregate("_samples", start, step, lambda acc: acc["kept"]).alias("_kept"))
    late = F.filter("_kept", lambda x: x["us"] >= (F.col("_b") + 1) * _BLOCK - _WINDOW)
    tails = accepted.select(by, "_b", late.alias("_tail")).where(F.size("_tail") > 0).withColumn("_b", F.col("_b") + 1)
    both = F.struct(F.coalesce("_tail", F.array().cast(kept)).alias("tail"), F.col("_kept").alias("own"))

    def rates(tail: Column, own: Column) -> Column:
        def rate(x: Column, i: Column, all_: Column) -> Column:
            place = i + F.size(tail)  # from 0
            near = F.when(place > 0, F.sequence(F.greatest(place - _MOST, F.lit(0)), place - 1))
            first = F.get(F.filter(near, lambda k: F.get(all_, k)["us"] >= x["us"] - _WINDOW), 0)
            return let(F.get(all_, first), lambda f: F.when(f.isNotNull(), F.greatest(x["total"] - f["total"], F.lit(0.0)) / ((x["us"] - f["us"]) / 1e6)))

        return let(F.concat(tail, own), lambda all_: F.transform(own, lambda x, i: rate(x, i, all_)))

    rated = accepted.join(tails, [by, "_b"], "left").select(by, "_b", "_samples", "_kept", let(both, lambda x: rates(x["tail"], x["own"])).alias("_rates"))
    averages = carried(rated.select(by, "_b", let(F.col("_rates"), _average_of).alias("_s")), by, _after, _average_of_run, "double")
    joined = rated.join(averages.withColumnRenamed("_state", "_held"), [by, "_b"])

    begin = F.struct(F.col("_held").alias("a"), F.array().cast("array<double>").alias("out"))
    onward = lambda acc, r: let(_smoothed(acc["a"], r), lambda a: F.struct(a.alias("a"), F.concat(acc["out"], F.array(a)).alias("out")))
    speeds = joined.select(by, "_b", "_samples", "_held", "_kept", F.aggregate("_rates", begin, onward, lambda acc: acc["out"]).alias("_speeds"))
    event = lambda x, speed: F.struct(x["us"].alias("us"), x["tie"].cast("long").alias("tie"), speed.alias("said"))
    none = F.lit(None).cast("struct<speed:double>")
    events = F.concat(F.zip_with("_kept", "_speeds", lambda x, v: event(x, F.struct(v.alias("speed")))), F.transform("_samples", lambda x: event(x, none)))
    listed = speeds.select(by, "_b", "_held", F.explode(events).alias("_e"))
    latest = Window.partitionBy(by, "_b").orderBy("_e.us", "_e.tie", F.col("_e.said").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    known = listed.withColumn("_last", F.last("_e.said", ignorenulls=True).over(latest)).where(F.col("_e.said").isNull())
    speed = F.when(F.col("_last").isNull(), F.col("_held")).otherwise(F.col("_last.speed"))
    return known.select(by, F.col("_e.tie").alias(tie), speed.alias("speed"))


def eta(progress: DataFrame, by: str = "transfer_id", tie: str = "event_id") -> DataFrame:
    """The smoothed remaining seconds after every sample; NULL in the warm-up and once all is done."""
    first = progress.groupBy(by).agg(F.min("ts").alias("_start"))
    joined = progress.join(first, by)
    frac = F.col("frac")
    elapsed = (F.unix_micros("ts") - F.unix_micros("_start")) / 1e6
    usable = (frac >= WARMUP_SHARE) & (frac < 1.0)
    raw = F.when(usable, elapsed * (1.0 - frac) / frac)
    ordered = joined.withColumn("_raw", raw).withColumn("_order", F.struct("ts", tie))
    day = F.floor(F.unix_micros("ts") / 86_400_000_000)
    numbered = running(
        ordered, [by], "_order", {"_n": Running("sum", F.when(F.col("_raw").isNotNull(), 1).otherwise(0).cast("long"))}, day
    )
    usable_rows = numbered.where(F.col("_raw").isNotNull()).select(by, tie, "_n", "_raw")
    known = linear_average(usable_rows, [by], "_n", "_raw", "eta").select(by, tie, "eta")
    return progress.select(by, tie).join(known, [by, tie], "left")


def linear_average(
    df: DataFrame, keys: list[str], position: str, value: str, name: str, weight: float = NEW_WEIGHT, block_rows: int = 512
) -> DataFrame:
    """Exponential average over all former rows; ``position`` numbers the rows of a group from 1.

    A block of rows turns the average ``a`` before it into ``c * a + d``: ``d`` comes from the block alone, as a running
    sum of values scaled by the weight's powers, and ``c`` is the rest's weight to the power of the rows so far. Blocks
    compose; after two whole ones ``c`` is below 1e-150, so a block takes up the two before it.
    """
    rest = 1.0 - weight
    number = F.floor((F.col(position) - 1) / block_rows)
    place = F.col(position) - 1 - number * block_rows
    scaled = F.when(F.col(position) == 1, F.lit(1.0)).otherwise(F.lit(weight)) * F.col(value) * F.pow(F.lit(rest), -place)
    own = Window.partitionBy(*keys, "_b").orderBy(position).rowsBetween(Window.unboundedPreceding, 0)
    local = df.withColumns({"_b": number, "_place": place, "_scaled": scaled})
    local = local.withColumn("_own", F.pow(F.lit(rest), F.col("_place")) * F.sum("_scaled").over(own))
    ends = local.groupBy(*keys, "_b").agg(F.max_by("_own", position).alias("_end"))
    order = Window.partitionBy(*keys).orderBy("_b")
    former = F.lag("_end", 1).over(order) + F.coalesce(F.lag("_end", 2).over(order), F.lit(0.0)) * rest**block_rows
    carried = ends.select(*keys, "_b", F.coalesce(former, F.lit(0.0)).alias("_carried"))
    joined = local.join(carried, [*keys, "_b"])
    average = F.col("_own") + F.pow(F.lit(rest), F.col("_place") + 1) * F.col("_carried")
    return joined.withColumn(name, average).drop("_b", "_place", "_scaled", "_own", "_carried")


def trailing(
    df: DataFrame, keys: list[str], order: str, value: str, n: int, name: str, block_rows: int = 50_000
) -> DataFrame:
    """The last ``n`` values up to every row, as an array; groups of any length are cut into overlapping blocks."""
    numbered = number_rows(df, keys, order, "_n", block_rows)
    block = F.floor((F.col("_n") - 1) / block_rows)
    last = F.col("_n") - block * block_rows > block_rows - (n - 1)
    copies = F.when(last, F.array(block, block + 1)).otherwise(F.array(block))
    spread = numbered.withColumn("_b", F.explode(copies)).withColumn("_own", F.col("_b") == block)
    window = Window.partitionBy(*keys, "_b").orderBy("_n").rowsBetween(-(n - 1), 0)
    return spread.withColumn(name, F.collect_list(value).over(window)).where("_own").drop("_b", "_own", "_n")


def _average(values: Column) -> Column:
    return F.aggregate(
        F.slice(values, 2, HISTORY),
        F.get(values, F.lit(0)).cast("double"),
        lambda acc, x: x * NEW_WEIGHT + acc * (1 - NEW_WEIGHT),
    )


def ewma_last_8(samples: DataFrame, by: str = "transfer_id", order: str = "seq", value: str = "throughput") -> DataFrame:
    """The exponential average over the last eight samples."""
    rows = trailing(samples, [by], order, value, HISTORY, "_v")
    return rows.withColumn("ewma", _average(F.col("_v"))).drop("_v")


def throughput_trend(samples: DataFrame, by: str = "transfer_id", order: str = "seq", value: str = "throughput") -> DataFrame:
    """The average, the one before it, and what follows: ``drop``, ``hold`` or ``up``."""
    rows = trailing(samples, [by], order, value, HISTORY + 1, "_v")
    v = F.col("_v")
    full = F.size(v) > HISTORY
    now = F.when(full, F.slice(v, 2, HISTORY)).otherwise(v)
    former = F.when(full, F.slice(v, 1, HISTORY)).otherwise(F.slice(v, F.lit(1), F.size(v) - 1))
    out = rows.withColumns({"ewma": _average(now), "previous": F.when(F.size(v) > 1, _average(former))})
    drop = (F.col("previous") - F.col("ewma")) / F.col("previous")
    trend = (
        F.when(F.coalesce(F.col("previous"), F.lit(0.0)) == 0, "up")
        .when(drop > DROP_SHARE, "drop")
        .when(drop > HOLD_SHARE, "hold")
        .otherwise("up")
    )
    return out.withColumn("trend", trend).drop("_v")


def retry_report(attempts: DataFrame, max_retries: int = 10, by: str = "transfer_id") -> DataFrame:
    """Failures worth a retry per transfer, against the budget its number of fragments gives it."""
    failed = F.col("status").isNull() | (F.col("status") >= 400)
    report = attempts.groupBy(by).agg(
        F.count(F.lit(1)).alias("attempts"),
        F.count_if(failed).alias("failures"),
        F.count_if(failed & is_retryable("status")).alias("retries"),
        F.max("fragments").alias("fragments"),
    )
    budget = F.greatest(F.floor(F.col("fragments") / RETRY_SHARE), F.lit(1)) * max_retries
    return report.withColumn("budget", budget).withColumn("exhausted", F.col("retries") > F.col("budget"))


def failure_breakdown(attempts: DataFrame) -> DataFrame:
    """Failed attempts by class."""
    s = F.col("status")
    failed = attempts.where(s.isNull() | (s >= 400))
    name = F.when(s.isNull(), "transport").otherwise(F.concat(F.lit("http_"), s.cast("string")))
    return failed.groupBy(name.alias("class"), is_retryable("status").alias("retryable")).agg(F.count(F.lit(1)).alias("n"))


def chunk_prefix(chunks: DataFrame, by: str = "download_id", block=1_000_000) -> DataFrame:
    """Per download the length-checked prefix without a gap: its chunks and bytes, the first bad id, what lies beyond.

    ``chunks`` has ``chunk_id`` (from 0), ``recorded_len`` and ``on_disk_len``.
    """
    intact = F.coalesce(F.col("on_disk_len") == F.col("recorded_len"), F.lit(False))
    rows = running(
        chunks,
        [by],
        "chunk_id",
        {
            "_n": Running("sum", F.lit(1).cast("long")),
            "_before": Running("sum", F.col("recorded_len"), exclusive=True),
        },
        block,
    )
    index = F.col("_n") - 1
    gap = F.col("chunk_id") != index
    bad = gap | ~intact
    first = F.struct(
        F.when(gap, index).otherwise(F.col("chunk_id")).alias("id"),
        gap.alias("gap"),
        index.alias("index"),
        F.coalesce(F.col("_before"), F.lit(0)).alias("bytes"),
    )
    found = rows.groupBy(by).agg(
        F.min_by(first, F.when(bad, index)).alias("_f"),
        F.count(F.lit(1)).alias("_total"),
        F.sum("recorded_len").alias("_bytes"),
    )
    total, f = F.col("_total"), F.col("_f")
    stranded = F.when(f.isNull(), F.lit(0)).otherwise(total - f["index"] - F.when(f["gap"], 0).otherwise(1))
    return found.select(
        by,
        F.coalesce(f["index"], total).alias("prefix_chunks"),
        F.coalesce(f["bytes"], F.col("_bytes")).alias("prefix_bytes"),
        f["id"].alias("first_bad"),
        stranded.alias("stranded"),
    )


def plan_chunks(files: DataFrame, size: str = "size") -> DataFrame:
    """One row per byte range of each file: ``chunk_id``, ``start`` and ``end`` (exclusive)."""
    sized = files.withColumn("chunk_size", chunk_size(size))
    rows = explode_range(sized, F.ceil(F.col(size) / F.col("chunk_size")), "chunk_id")
    start = F.col("chunk_id") * F.col("chunk_size")
    return rows.withColumns({"start": start, "end": F.least(start + F.col("chunk_size"), F.col(size))})


def job_status(events: DataFrame, by: str = "job_id") -> DataFrame:
    """The latest status of each job, and whether the job is over."""
    latest = events.groupBy(by).agg(F.max_by("status", F.struct("ts_us", "seq")).alias("status"))
    return latest.withColumn("terminal", F.col("status").isin("completed", "failed", "cancelled"))
