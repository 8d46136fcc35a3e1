"""Whole format selections: targets, fallbacks, merges, groups.

A selection is a list of targets. A target is a list of alternatives, of which the first that yields a format
counts. An alternative is a ``Pick``, a ``Merge`` of two picks, ``AllFormats``, ``Mergeable`` or a ``Group``.
All picks of all targets come from one aggregation per media item; the alternatives are then weighed within
that one row.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mediacat.operators.catalog import has_audio, has_video
from mediacat.operators.predicates import FormatFilter, all_filters, not_drm, stream_type_filter
from mediacat.operators.ranking import DEFAULT_ORDER, SortField, nth, rank_key, row_struct


@dataclass(frozen=True)
class Pick:
    """One format: the best or worst of a stream type, the N-th of it, one id, or the best of one extension."""

    stream: str = "any"
    worst: bool = False
    star: bool = False
    n: int | None = None
    format_id: str | None = None
    ext: str | None = None
    filters: tuple[FormatFilter, ...] = ()


@dataclass(frozen=True)
class Merge:
    video: Pick
    audio: Pick


@dataclass(frozen=True)
class AllFormats:
    """Every format without DRM, best first."""


@dataclass(frozen=True)
class Mergeable:
    """Every format without DRM that has video or audio, worst first."""


@dataclass(frozen=True)
class Group:
    """Targets tried in turn; the filters apply to what a target yields."""

    targets: tuple[tuple, ...]
    filters: tuple[FormatFilter, ...] = ()


Target = Sequence[Pick | Merge | AllFormats | Mergeable | Group]

BEST_VIDEO_PLUS_AUDIO: tuple = (
    Merge(Pick("video", star=True), Pick("audio")),
    Pick("any"),
)


def _candidates(p: Pick) -> Column:
    if p.format_id is not None:
        base = F.col("format_id") == p.format_id
    elif p.ext is not None:
        base = F.col("ext") == p.ext
    else:
        base = stream_type_filter(p.stream, p.star)
    return not_drm() & F.coalesce(base, F.lit(False)) & all_filters(p.filters)


def _falls_back(p: Pick) -> bool:
    """``best`` takes any stream where the media item has no muxed format at all."""
    return p.stream == "any" and not p.worst and not p.star and p.format_id is None and p.ext is None


def _stream_candidates(p: Pick) -> Column:
    return not_drm() & (has_video() | has_audio()) & all_filters(p.filters)


@dataclass
class _Leaf:
    """One leaf of a selection, with the outer filters of the groups around it."""

    kind: Pick | Merge | AllFormats | Mergeable
    filters: tuple[FormatFilter, ...] = ()


@dataclass
class _Plan:
    leaves: list[_Leaf] = field(default_factory=list)

    def picks(self) -> list[Pick]:
        found: dict[Pick, None] = {}
        for leaf in self.leaves:
            for p in _picks_of(leaf.kind):
                found[p] = None
        return list(found)


def _picks_of(kind) -> list[Pick]:
    if isinstance(kind, Pick):
        return [kind]
    if isinstance(kind, Merge):
        return [kind.video, kind.audio]
    return []


class _Weigh:
    """Finds, inside one aggregated row, the leaf each target ends in."""

    def __init__(self, names: dict[Pick, str]):
        self.names = names
        self.leaves: list[_Leaf] = []
        self.bulk: dict[tuple, str] = {}

    def items(self, leaf: _Leaf) -> Column:
        found = [F.col(self.names[p]) for p in _picks_of(leaf.kind)]
        kept = F.filter(F.array(*found), lambda f: f.isNotNull())
        if isinstance(leaf.kind, Merge):
            kept = F.when(found[0].isNotNull() & found[1].isNotNull(), kept)
        if leaf.filters:
            kept = F.filter(kept, lambda f: all_filters(leaf.filters, lambda n: f[n]))
        return kept

    def is_bulk(self, leaf: _Leaf) -> bool:
        return isinstance(leaf.kind, (AllFormats, Mergeable))

    def filled(self, leaf: _Leaf) -> Column:
        if self.is_bulk(leaf):
            key = (type(leaf.kind), leaf.filters)
            name = self.bulk.setdefault(key, f"_n{len(self.bulk)}")
            return F.col(name)
        return F.coalesce(F.size(self.items(leaf)) > 0, F.lit(False))

    def target(self, alternatives: Target) -> tuple[Column, list[int]]:
        """The id of the chosen leaf (NULL if nothing is found) and the ids it can be."""
        chosen, ids = [], []
        for a in alternatives:
            if isinstance(a, Group):
                column, below = self.group(a)
                chosen.append(column)
                ids += below
            else:
                self.leaves.append(_Leaf(a))
                i = len(self.leaves) - 1
                chosen.append(F.when(self.filled(self.leaves[i]), F.lit(i)))
                ids.append(i)
        return F.coalesce(*chosen), ids

    def group(self, g: Group) -> tuple[Column, list[int]]:
        chosen, ids = [], []
        for t in g.targets:
            column, below = self.target(t)
            if g.filters:
                kept = F.lit(None).cast("int")
                for i in below:
                    leaf = self.leaves[i]
                    narrowed = _Leaf(leaf.kind, (*leaf.filters, *g.filters))
                    kept = F.when((column == i) & self.filled(narrowed), F.lit(i)).otherwise(kept)
                    self.leaves[i] = narrowed
                column = kept
            chosen.append(column)
            ids += below
        return F.coalesce(*chosen), ids


def bulk_condition(kind: type, filters: Sequence[FormatFilter]) -> Column:
    base = not_drm() if kind is AllFormats else not_drm() & (has_video() | has_audio())
    return base & all_filters(filters)


def select_targets(
    df: DataFrame,
    targets: Sequence[Target],
    order: Sequence[SortField] = DEFAULT_ORDER,
    by: str = "media_id",
    ordinal: str = "ordinal",
    columns: Sequence[str] | None = None,
) -> DataFrame:
    """Rows ``(by, target, part, columns...)``; media items for which a target finds nothing have no row of it.

    ``part`` numbers the formats of one target (video before audio in a merge). ``AllFormats`` and ``Mergeable``
    yield any number of rows, so these are not numbered within one task; ``part`` is NULL and ``rank_key`` orders them.
    """
    columns = [c for c in (columns or df.columns) if c != by]
    plan = _Plan()
    _collect(targets, plan)
    picks = plan.picks()
    names = {p: f"_p{i}" for i, p in enumerate(picks)}
    weigh = _Weigh(names)
    chosen = [weigh.target(t)[0] for t in targets]

    # What group filters look at must be in the picked structs.
    filter_fields = {f.field for leaf in weigh.leaves for f in leaf.filters if f.field in df.columns}
    kept = list(dict.fromkeys([*columns, *sorted(filter_fields)]))
    row = row_struct(df, kept)
    # The key of every candidate is computed once, below the aggregation.
    keyed = df.withColumn("_k", rank_key(order)).withColumn("_row", row)
    aggregates = []
    for p, name in names.items():
        if p.n is not None:
            continue
        key = F.struct("_k", ordinal)
        pick = F.min_by if p.worst else F.max_by
        own = pick(F.col("_row"), F.when(_candidates(p), key))
        aggregates.append(own.alias(name))
        if _falls_back(p):
            aggregates.append(pick(F.col("_row"), F.when(_stream_candidates(p), key)).alias(f"{name}_any"))
    any_muxed = not_drm() & has_video() & has_audio()
    aggregates.append(F.coalesce(F.bool_or(any_muxed), F.lit(False)).alias("_muxed"))
    for (kind, filters), name in weigh.bulk.items():
        aggregates.append((F.count_if(bulk_condition(kind, filters)) > 0).alias(name))
    per_media = keyed.groupBy(by).agg(*aggregates)
    for p, name in names.items():
        if p.n is not None:
            found = nth(df.where(_candidates(p)), max(p.n, 1), p.worst, order, by, ordinal)
            if _falls_back(p):
                streams = nth(df.where(_stream_candidates(p)), max(p.n, 1), p.worst, order, by, ordinal)
                none = df.where(_candidates(p)).select(by).distinct()
                found = found.unionByName(streams.join(none, by, "left_anti").join(
                    per_media.where(~F.col("_muxed")).select(by), by, "left_semi"))
            per_media = per_media.join(found.select(by, row.alias(name)), by, "left")
        elif _falls_back(p):
            per_media = per_media.withColumn(
                name, F.coalesce(F.col(name), F.when(~F.col("_muxed"), F.col(f"{name}_any")))
            )

    ids = per_media.withColumns({f"_c{t}": c for t, c in enumerate(chosen)})
    empty = F.array().cast(f"array<{_row_type(df, kept)}>")
    per_target = []
    for t in range(len(targets)):
        rows = empty
        for i, leaf in enumerate(weigh.leaves):
            if not weigh.is_bulk(leaf):
                rows = F.when(F.col(f"_c{t}") == i, weigh.items(leaf)).otherwise(rows)
        per_target.append(
            F.struct(F.lit(t).alias("target"), F.col(f"_c{t}").alias("leaf"), rows.alias("rows"))
        )
    exploded = ids.select(by, F.explode(F.array(*per_target)).alias("_t"))
    picked = exploded.select(by, "_t.target", F.posexplode("_t.rows").alias("part", "_f")).select(
        by, "target", "part", *[F.col(f"_f.{c}").alias(c) for c in columns]
    )
    bulk = [(i, leaf) for i, leaf in enumerate(weigh.leaves) if weigh.is_bulk(leaf)]
    if not bulk:
        return picked
    wanted = exploded.select(by, "_t.target", "_t.leaf")
    for i, leaf in bulk:
        rows = df.where(bulk_condition(type(leaf.kind), leaf.filters))
        of_leaf = wanted.where(F.col("leaf") == i).select(by, "target")
        picked = picked.unionByName(
            rows.join(of_leaf, by, "inner").select(by, "target", F.lit(None).cast("int").alias("part"), *columns)
        )
    return picked


def _row_type(df: DataFrame, columns: Sequence[str]) -> str:
    return df.select(F.struct(*columns).alias("r")).schema["r"].dataType.simpleString()


def _collect(targets: Sequence[Target], plan: _Plan) -> None:
    for t in targets:
        for a in t:
            if isinstance(a, Group):
                _collect(a.targets, plan)
            else:
                plan.leaves.append(_Leaf(a))


def select_formats(
    df: DataFrame,
    target: Target = BEST_VIDEO_PLUS_AUDIO,
    order: Sequence[SortField] = DEFAULT_ORDER,
    by: str = "media_id",
    ordinal: str = "ordinal",
    columns: Sequence[str] | None = None,
) -> DataFrame:
    """The formats one target selects; by default best video plus best audio, or else the best muxed format."""
    return select_targets(df, [target], order, by, ordinal, columns).drop("target")


def merge_video_audio(
    df: DataFrame,
    video: Pick = Pick("video", star=True),
    audio: Pick = Pick("audio"),
    order: Sequence[SortField] = DEFAULT_ORDER,
    by: str = "media_id",
    ordinal: str = "ordinal",
    columns: Sequence[str] | None = None,
) -> DataFrame:
    """Pairs of a video and an audio pick, only where both exist."""
    return select_targets(df, [(Merge(video, audio),)], order, by, ordinal, columns).drop("target")


def first_non_empty(df: DataFrame, by: str = "media_id", branch: str = "branch") -> DataFrame:
    """The rows of each item's lowest-numbered branch.

    The minimum is aggregated before it is joined back, so no item's rows meet in one task.
    """
    first = df.groupBy(by).agg(F.min(branch).alias("_first"))
    joined = df.join(first, by, "inner")
    return joined.where(F.col(branch) == F.col("_first")).drop("_first")


# --- the pick without a sorter --------------------------------------------------------------------------------

# What is compared, in turn; only the columns after the first marker tolerate a missing side.
_HEURISTIC = {
    "audio": ((), ("abr",), ("asr",)),
    "video": (("height",), ("vbr", "fps"), ()),
    "any": (("quality", "height"), ("tbr", "fps"), ()),
}

def heuristic_best(
    df: DataFrame,
    stream: str = "any",
    worst: bool = False,
    by: str = "media_id",
    ordinal: str = "ordinal",
    columns: Sequence[str] | None = None,
) -> DataFrame:
    """The pick that treats a missing bitrate as equal to any, so that it depends on the order of the formats.

    Only formats that are best in the leading, totally ordered columns can win; an aggregation finds these. The rest is
    a fold in order that does not compose, so each item's rows are one sorted stream, of any length, with one row of
    state. The stream holds the compared columns alone; the winner's others are joined to it.
    """
    strict, loose, last = _HEURISTIC[stream]
    columns = [c for c in (columns or df.columns) if c != by]
    lead = F.struct(F.lit(0), *[F.col(c) for c in strict])
    keyed = df.select(by, ordinal, lead.alias("_lead"), *dict.fromkeys([*loose, *last]))
    top = keyed.groupBy(by).agg((F.min if worst else F.max)("_lead").alias("_top"))
    final = keyed.join(top, by).where(F.col("_lead").eqNullSafe(F.col("_top"))).drop("_lead", "_top")
    ordered = final.repartition(by).sortWithinPartitions(by, ordinal)

    def place(x):
        return (x != x, x)  # NaN is above every number

    def better(a: dict, b: dict) -> bool:
        """Whether b takes the place of a."""
        for c in (*loose, *last):
            x, y = a[c], b[c]
            if x is None or y is None:
                if c in loose or x is y:
                    continue
                return (x is None) != worst
            if place(x) != place(y):
                return (place(x) < place(y)) != worst
        return not worst

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, kinds = None, None
        for batch in batches:
            done, kinds = [], batch.schema
            for row in batch.to_pylist():
                if best is None or row[by] != best[by]:
                    done += [best] if best is not None else []
                    best = row
                elif better(best, row):
                    best = row
            yield pa.RecordBatch.from_pylist(done, kinds).select([by, ordinal])
        if best is not None:
            yield pa.RecordBatch.from_pylist([best], kinds).select([by, ordinal])

    winners = ordered.mapInArrow(fold, final.select(by, ordinal).schema)
    return df.join(winners, [by, ordinal]).select(by, *columns)
