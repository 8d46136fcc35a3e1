"""Queries over transfer telemetry."""

from __future__ import annotations

from pyspark.sql import functions as F

from mediacat.operators import telemetry
from mediacat.plans.registry import query

_HISTORY = "list(throughput) over (partition by transfer_id order by seq rows between {0} preceding and {1})"
_FOLD = "round(list_reduce(list_transform({0}, lambda x: x::double), lambda a, x: x * 0.3::double + a * 0.7::double), 9)"


@query(
    "F13_ewma_last_8",
    f"select transfer_id, seq, {_FOLD.format('v')} as ewma from (select transfer_id, seq, {_HISTORY.format(7, 'current row')} as v from {{samples}})",
)
def _(t):
    rows = telemetry.ewma_last_8(t.samples)
    return rows.select("transfer_id", "seq", F.round("ewma", 9).alias("ewma"))


@query(
    "F14_throughput_trend",
    f"""with h as (select transfer_id, seq, {_HISTORY.format(7, 'current row')} as v, {_HISTORY.format(8, '1 preceding')} as p from {{samples}}),
         e as (select transfer_id, seq, list_reduce(list_transform(v, lambda x: x::double), lambda a, x: x * 0.3::double + a * 0.7::double) as ewma,
           case when len(p) > 0 then list_reduce(list_transform(p, lambda x: x::double), lambda a, x: x * 0.3::double + a * 0.7::double) end as previous from h)
       select transfer_id, seq, case when coalesce(previous, 0) = 0 then 'up' when (previous - ewma) / previous > 0.3 then 'drop'
         when (previous - ewma) / previous > 0.1 then 'hold' else 'up' end as trend from e""",
)
def _(t):
    return telemetry.throughput_trend(t.samples).select("transfer_id", "seq", "trend")


@query(
    "F10_chunk_prefix",
    """with n as (select *, row_number() over (partition by download_id order by chunk_id) - 1 as i from {chunks}),
         b as (select *, chunk_id <> i as gap, chunk_id <> i or on_disk_len <> recorded_len as bad from n),
         f as (select download_id, count(*) as total, min(i) filter (bad) as first from b group by 1)
       select f.download_id, coalesce(first, total) as prefix_chunks, coalesce(first, total) * 65536 as prefix_bytes,
         case when b.gap then b.i else b.chunk_id end as first_bad, coalesce(total - first - (not b.gap)::int, 0) as stranded
       from f left join b on b.download_id = f.download_id and b.i = f.first""",
)
def _(t):
    return telemetry.chunk_prefix(t.chunks)


@query(
    "J11_plan_chunks",
    """select o_orderkey, i as chunk_id, i * c as start, least((i + 1) * c, size) as "end" from (
         select o_orderkey, size, least(greatest(pow(2, ceil(log2(greatest(least(size // 1024, 8388608), 65536))))::bigint, 65536), 8388608) as c
         from (select o_orderkey, floor(o_totalprice)::bigint * 4 as size from orders)), range(0, 4000) r(i) where i * c < size""",
)
def _(t):
    sized = t.orders.select("o_orderkey", (F.floor("o_totalprice") * 4).alias("size"))
    return telemetry.plan_chunks(sized).select("o_orderkey", "chunk_id", "start", "end")


# The fold of the meter, step by step in order; samples of one transfer come one after another.
_METER = """with recursive p as (select transfer_id, event_id, epoch_us(ts) as us, cumulative_bytes as b,
    row_number() over (partition by transfer_id order by ts, event_id) as n from {progress}),
  walk as (
    select transfer_id, event_id, n, us as last, [{'t': us, 'b': b}] as w, null::double as speed from p where n = 1
    union all
    select x.transfer_id, x.event_id, x.n, case when ok then x.us else walk.last end,
      case when ok then nw else walk.w end,
      case when not ok then walk.speed when len(nw) < 2 then null
        else (case when walk.speed is null then raw else 0.3::double * raw + 0.7::double * walk.speed end) end
    from walk join p x on x.transfer_id = walk.transfer_id and x.n = walk.n + 1,
      lateral (select x.us - walk.last >= 50000 as ok, list_filter(list_append(walk.w, {'t': x.us, 'b': x.b}), lambda s: x.us - s.t <= 3000000) as nw),
      lateral (select (x.b - nw[1].b)::double / ((x.us - nw[1].t) / 1000000.0::double) as raw))
  select transfer_id, event_id, round(speed, 4) as speed from walk"""


@query("K1_speed_meter", _METER)
def _(t):
    rows = telemetry.speed_meter(t.progress)
    return rows.select("transfer_id", "event_id", F.round("speed", 4).alias("speed"))


_ETA = """with recursive s as (select transfer_id, event_id, ts, frac, (epoch_us(ts) - min(epoch_us(ts)) over (partition by transfer_id)) / 1000000.0::double as elapsed from {progress}),
  u as (select transfer_id, event_id, elapsed * (1 - frac) / frac as raw, row_number() over (partition by transfer_id order by ts, event_id) as n
    from s where frac >= 0.005 and frac < 1),
  walk as (select transfer_id, event_id, n, raw as eta from u where n = 1
    union all select u.transfer_id, u.event_id, u.n, 0.3::double * u.raw + 0.7::double * walk.eta from walk join u on u.transfer_id = walk.transfer_id and u.n = walk.n + 1)
  select p.transfer_id, p.event_id, round(eta, 4) as eta from {progress} p left join walk using (transfer_id, event_id)"""


@query("K2_eta", _ETA)
def _(t):
    rows = telemetry.eta(t.progress)
    return rows.select("transfer_id", "event_id", F.round("eta", 4).alias("eta"))


@query(
    "K5_job_status",
    """select job_id, status, status in ('completed', 'failed', 'cancelled') as terminal from {jobs}
       qualify row_number() over (partition by job_id order by ts_us desc, seq desc) = 1""",
)
def _(t):
    return telemetry.job_status(t.jobs)
