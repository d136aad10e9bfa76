"""Ordered-series operators that stay balanced when one series holds a large share of rows.

A series is the set of rows sharing ``keys``, ordered by ``order`` (the order columns must
make the order unique, e.g. ``(ts, event_id)``).

The naive plan for a prefix operation (forward fill, row number, lags) is one
``Window.partitionBy(*keys)``: every row of a series lands in one task, so a device that
holds a third of the data becomes a third of the job in a single task. Here every such
operation runs in two phases instead:

1. ``repartitionByRange(n, *keys, *order)`` cuts the sorted rows into ``n`` contiguous
   ranges of similar size; a hot series simply spans many ranges. The range index
   (``spark_partition_id``) tags each row: the pair (range, keys) is a *segment*, whose
   size is bounded by the range size whatever the skew.
2. Window functions run per segment (``partitionBy(_seg, _sk)``, ``_sk`` = the keys packed
   in one struct); a per-segment summary
   (row count, last/first non-null value, last ``L`` values) has one row per segment.
   Carrying the summary across the earlier/later segments of the same series is a window
   over that small table (at most ``n`` rows per series). The carried values are joined
   back on (segment, keys); the big side is already hash-partitioned on exactly these
   columns by step 2, so the join adds no shuffle of the big side (AQE broadcasts the
   summary outright when it is measured small).

The results are exactly those of the single-window formulation. Cost versus the naive
plan: one checkpoint write of the needed columns, in exchange for bounded tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window as W, functions as F

from tidemark.session import ensure_checkpoint_dir

SEG = "_seg"
KEY = "_sk"
RID = "_rid"


def _pack(keys) -> "F.Column":
    """All series keys as one struct column. Struct equality treats null fields as equal,
    so a plain equi-join on it is null-safe, and windows and joins on (SEG, KEY) share
    one hash partitioning (a ``<=>`` join on the raw keys would compile to coalesce/isnull
    expressions and force the big side through another shuffle)."""
    return F.struct(*[F.col(k) for k in keys]) if keys else F.lit(0)


def _cols(cs) -> list[str]:
    if cs is None:
        return []
    if isinstance(cs, str):
        return [cs]
    return list(cs)


def segmented(df: DataFrame, keys: Sequence[str], order: Sequence[str],
              partitions: int | None = None) -> DataFrame:
    """Range-partition by (keys, order) and tag every row with its range index.

    The tagged rows are checkpointed (reliably, into ``spark.checkpoint.dir``). The row
    branch and the summary branch of every operator below read this one copy: two
    independent range exchanges would sample their own cut points (column pruning makes
    their plans differ, so Spark cannot reuse one for the other) and the segment ids of
    the two branches would disagree. The checkpoint also cuts the lineage, so a lost
    executor never re-runs the range shuffle.
    """
    keys, order = _cols(keys), _cols(order)
    ensure_checkpoint_dir(df.sparkSession)
    if partitions:
        ranged = df.repartitionByRange(int(partitions), *keys, *order)
    else:
        # No explicit count: the exchange starts with the session's width
        # (``spark.sql.adaptive.coalescePartitions.initialPartitionNum``, see session.py) and
        # AQE merges adjacent ranges to its advisory partition size by the bytes it has
        # written, so the number of segments follows the data. Merged ranges are still
        # contiguous in (keys, order), which is all a segment needs.
        ranged = df.repartitionByRange(*keys, *order)
    # Rows are sorted inside each range and stamped with a row id that increases in
    # (keys, order): segment windows then order by one long, and "last value in series
    # order" is a hash-aggregatable max_by on it. The checkpoint fixes the ids.
    tagged = (ranged.sortWithinPartitions(*keys, *order)
                    .withColumns({SEG: F.spark_partition_id(),
                                  RID: F.monotonically_increasing_id()})
                    .checkpoint(eager=True))
    # The packed key is a pure function of the row: computed after the checkpoint so the
    # key columns are not written twice.
    return tagged.withColumn(KEY, _pack(keys))


def _local_window(keys, order, descending: bool = False):
    """Window over one segment of one series, in series order (or reversed)."""
    return W.partitionBy(SEG, KEY).orderBy(F.col(RID).desc() if descending else F.col(RID))


def _across_segments(keys):
    """Window over the per-segment summary of one series, in segment order."""
    return W.partitionBy(KEY).orderBy(SEG)


def _join_back(big: DataFrame, summary: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Attach per-segment carried values: equi-join on (SEG, KEY)."""
    return big.join(summary, [SEG, KEY], "inner")


def with_position(df: DataFrame, keys: Sequence[str], order: Sequence[str],
                  out: str = "pos", total: str | None = None,
                  partitions: int | None = None) -> DataFrame:
    """0-based position of each row within its series (``row_number() - 1``), skew-safe.

    With ``keys=[]`` this numbers the whole table in ``order`` without funnelling it
    through a single task. ``total`` names an optional column with the series length.
    """
    keys, order = _cols(keys), _cols(order)
    s = segmented(df, keys, order, partitions)
    # Rows of a segment have consecutive row ids, so the first one gives the local position:
    # no window over the big side.
    counts = s.groupBy(SEG, KEY).agg(F.count(F.lit(1)).alias("_n"), F.min(RID).alias("_rid0"))
    before = _across_segments(keys).rowsBetween(W.unboundedPreceding, -1)
    whole = _across_segments(keys).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    extra = [F.sum("_n").over(whole).alias(total)] if total else []
    counts = counts.select(SEG, KEY,
                           (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_rid0"))
                           .alias("_off"), *extra)
    res = _join_back(s, counts, keys)
    return (res.withColumn(out, (F.col("_off") + F.col(RID)).cast("long"))
               .drop("_off", SEG, KEY, RID))


def with_running_total(df: DataFrame, keys: Sequence[str], order: Sequence[str],
                       weight: str, out: str = "before", total: str | None = None,
                       partitions: int | None = None) -> DataFrame:
    """Sum of ``weight`` over the rows *before* each row in its series (exclusive prefix
    sum), skew-safe; ``total`` optionally names a column with the series total.

    ``with_position`` is the special case ``weight = 1``.
    """
    keys, order = _cols(keys), _cols(order)
    s = segmented(df, keys, order, partitions)
    upto = _local_window(keys, order).rowsBetween(W.unboundedPreceding, -1)
    local = s.withColumn("_lsum", F.coalesce(F.sum(weight).over(upto), F.lit(0)))
    sums = s.groupBy(SEG, KEY).agg(F.sum(weight).alias("_w"))
    before = _across_segments(keys).rowsBetween(W.unboundedPreceding, -1)
    whole = _across_segments(keys).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    extra = [F.sum("_w").over(whole).alias(total)] if total else []
    sums = sums.select(SEG, KEY, F.coalesce(F.sum("_w").over(before), F.lit(0)).alias("_off"),
                       *extra)
    res = _join_back(local, sums, keys)
    return res.withColumn(out, F.col("_off") + F.col("_lsum")).drop("_off", "_lsum", SEG, KEY, RID)


def fill_gaps(df: DataFrame, keys: Sequence[str], order: Sequence[str],
              cols: Sequence[str], backward: bool = True,
              suffix: str = "", partitions: int | None = None) -> DataFrame:
    """Forward fill nulls in series order; then (``backward``) back-fill the leading gap.

    pandas ``fillna(method='ffill')`` followed by ``fillna(method='bfill')``: a null takes
    the last earlier non-null value of its series, and nulls before the first value take
    that first value. A series with no value at all stays null.
    Result columns replace ``cols`` (or are added as ``col+suffix``).
    """
    keys, order, cols = _cols(keys), _cols(order), _cols(cols)
    s = segmented(df, keys, order, partitions)
    wl = _local_window(keys, order)
    upto = wl.rowsBetween(W.unboundedPreceding, 0)
    after = wl.rowsBetween(0, W.unboundedFollowing)
    local = s
    for c in cols:
        local = local.withColumn(f"_ff_{c}", F.last(c, ignorenulls=True).over(upto))
        if backward:
            local = local.withColumn(f"_bf_{c}", F.first(c, ignorenulls=True).over(after))
    okey = F.col(RID)
    aggs = []
    for c in cols:
        has = F.col(c).isNotNull()
        aggs.append(F.max_by(F.col(c), F.when(has, okey)).alias(f"_last_{c}"))
        if backward:
            aggs.append(F.min_by(F.col(c), F.when(has, okey)).alias(f"_first_{c}"))
    summ = s.groupBy(SEG, KEY).agg(*aggs)
    prev = _across_segments(keys).rowsBetween(W.unboundedPreceding, -1)
    nxt = _across_segments(keys).rowsBetween(1, W.unboundedFollowing)
    sel = [F.col(SEG), F.col(KEY)]
    for c in cols:
        sel.append(F.last(f"_last_{c}", ignorenulls=True).over(prev).alias(f"_cf_{c}"))
        if backward:
            sel.append(F.first(f"_first_{c}", ignorenulls=True).over(nxt).alias(f"_cb_{c}"))
    summ = summ.select(*sel)
    res = _join_back(local, summ, keys)
    for c in cols:
        parts = [F.col(f"_ff_{c}"), F.col(f"_cf_{c}")]
        if backward:
            parts += [F.col(f"_bf_{c}"), F.col(f"_cb_{c}")]
        res = res.withColumn(c + suffix, F.coalesce(*parts))
        res = res.drop(f"_ff_{c}", f"_cf_{c}", f"_bf_{c}", f"_cb_{c}")
    return res.drop(SEG, KEY, RID)


def _with_context(df: DataFrame, keys, order, col: str, before: int, after: int,
                  partitions: int | None, position: str | None = None):
    """Segment-local frame plus the values of ``col`` just outside each segment:

    * ``_pre``: the last ``before`` values preceding the segment in its series (oldest
      first), gathered across any number of earlier segments;
    * ``_post``: the first ``after`` values following it (nearest first).

    Every segment has at least one row, so the ``before`` preceding (``after`` following)
    segments always suffice. Nulls are kept in place: positions matter for lags. Returns
    (frame, local window); the frame has ``_lpos`` / ``_rpos`` (0-based position from the
    segment start / end) and, where asked, the position in the whole series.
    """
    s = segmented(df, keys, order, partitions)
    wl = _local_window(keys, order)
    # Position from the segment end without a second (descending) sort: segment size
    # (a frame over the whole segment, no ordering needed) minus position from the start.
    whole = W.partitionBy(SEG, KEY)
    local = s.withColumn("_lpos", F.row_number().over(wl) - 1)
    local = local.withColumn("_rpos", F.count(F.lit(1)).over(whole) - 1 - F.col("_lpos"))
    item = F.struct(F.col("_lpos").alias("p"), F.col(col).alias("v"))
    aggs = []
    if before:
        aggs.append(F.sort_array(F.collect_list(F.when(F.col("_rpos") < before, item)))
                    .alias("_tail"))
    if after:
        aggs.append(F.sort_array(F.collect_list(F.when(F.col("_lpos") < after, item)))
                    .alias("_head"))
    edge = (F.col("_rpos") < before) | (F.col("_lpos") < after)
    if position:  # a segment's size stands in its last row, an edge row
        aggs.append((F.max("_lpos") + 1).alias("_n"))
        edge = edge | (F.col("_rpos") == 0)
    summ = local.where(edge).groupBy(SEG, KEY).agg(*aggs)
    sel = [F.col(SEG), F.col(KEY)]
    if position:
        earlier = _across_segments(keys).rowsBetween(W.unboundedPreceding, -1)
        sel.append(F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_off"))
    if before:
        hist = F.flatten(F.collect_list("_tail").over(
            _across_segments(keys).rowsBetween(-before, -1)))
        start = F.greatest(F.size(hist) - before + 1, F.lit(1))
        sel.append(F.transform(F.slice(hist, start, before), lambda x: x["v"]).alias("_pre"))
    if after:
        fut = F.flatten(F.collect_list("_head").over(
            _across_segments(keys).rowsBetween(1, after)))
        sel.append(F.transform(F.slice(fut, 1, after), lambda x: x["v"]).alias("_post"))
    res = _join_back(local, summ.select(*sel), keys)
    if position:
        res = res.withColumn(position, (F.col("_off") + F.col("_lpos")).cast("long")).drop("_off")
    return res, wl


def lag_features(df: DataFrame, keys, order, col: str, lags: int = 20,
                 leads: int = 0, prefix: str | None = None,
                 partitions: int | None = None, position: str | None = None) -> DataFrame:
    """``{prefix}_lag_1..lags`` (previous values) and ``{prefix}_lead_1..leads`` (next
    values) of ``col``: exact equivalents of ``lag(col, i)`` / ``lead(col, i)`` over the
    whole series, from one segmentation and one window function per row: the values around
    a row are gathered once and indexed. ``position`` adds the 0-based series position."""
    keys, order = _cols(keys), _cols(order)
    prefix = prefix or col
    frame, wl = _with_context(df, keys, order, col, lags, leads, partitions, position)
    near = F.collect_list(F.struct(F.col(col).alias("v"))).over(wl.rowsBetween(-lags, leads))
    frame = frame.withColumn("_near", near).withColumn("_here", F.least(F.col("_lpos"), F.lit(lags)))
    new = {}
    m = F.size("_pre") if lags else None
    for i in range(1, lags + 1):
        outside = F.get("_pre", (m - F.lit(i) + F.col("_lpos")).cast("int"))
        new[f"{prefix}_lag_{i}"] = F.when(F.col("_lpos") >= i, F.get("_near", F.col("_here") - i)["v"]) \
                                    .otherwise(outside)
    for i in range(1, leads + 1):
        outside = F.get("_post", (F.lit(i - 1) - F.col("_rpos")).cast("int"))
        new[f"{prefix}_lead_{i}"] = F.when(F.col("_rpos") >= i, F.get("_near", F.col("_here") + i)["v"]) \
                                     .otherwise(outside)
    out = frame.withColumns(new)
    return out.drop("_pre", "_post", "_lpos", "_rpos", "_near", "_here", SEG, KEY, RID)


def sliding_window(df: DataFrame, keys, order, col: str, size: int = 30,
                   out_prefix: str = "win", partitions: int | None = None) -> DataFrame:
    """Row-count window of the last ``size`` values ending at each row.

    Adds ``{out}_values`` (array, oldest first; nulls kept), ``{out}_n`` (points in the
    window, < ``size`` near the start of a series) -- the rows-frame
    ``collect_list(..).over(rowsBetween(-(size-1), 0))`` computed segment-locally.
    """
    keys, order = _cols(keys), _cols(order)
    depth = size - 1
    frame, wl = _with_context(df, keys, order, col, depth, 0, partitions)
    local_vals = F.transform(
        F.collect_list(F.struct(F.col(col).alias("v"))).over(wl.rowsBetween(-depth, 0)),
        lambda x: x["v"])
    allv = F.concat(F.col("_pre"), local_vals)
    start = F.greatest(F.size(allv) - size + 1, F.lit(1))
    vals = F.slice(allv, start, size)
    # The history is only needed while the row is within `depth` of its segment start.
    vals = F.when(F.col("_lpos") >= depth, local_vals).otherwise(vals)
    res = (frame.withColumn(f"{out_prefix}_values", vals)
                .withColumn(f"{out_prefix}_n", F.size(f"{out_prefix}_values")))
    return res.drop("_pre", "_lpos", "_rpos", SEG, KEY, RID)


def sliding_sum(df: DataFrame, keys, order, col: str, size: int = 30,
                out_sum: str = "win_sum", out_n: str = "win_n", cast: str | None = None,
                partitions: int | None = None) -> DataFrame:
    """Sum of ``col`` and number of rows over the last ``size`` rows ending at each row.

    Native rows-frame aggregates inside each segment; only rows within ``size - 1`` of a
    segment start add the tail carried from the preceding segments. ``cast`` sums in
    another type (e.g. ``decimal(18,2)`` for exact money).
    """
    keys, order = _cols(keys), _cols(order)
    depth = size - 1
    frame, wl = _with_context(df, keys, order, col, depth, 0, partitions)
    v = F.col(col).cast(cast) if cast else F.col(col)
    fr = wl.rowsBetween(-depth, 0)
    local_sum, local_n = F.sum(v).over(fr), F.count(F.lit(1)).over(fr)
    need = F.greatest(F.lit(depth) - F.col("_lpos"), F.lit(0))
    extra = F.slice("_pre", F.greatest(F.size("_pre") - need + 1, F.lit(1)),
                    F.least(need, F.size("_pre")))
    zero = F.lit(0).cast(cast) if cast else F.lit(0.0)
    extra_sum = F.aggregate(extra, zero,
                            lambda a, x: (a + F.coalesce(x.cast(cast) if cast else x, zero))
                            .cast(cast) if cast else a + F.coalesce(x, zero))
    near = F.col("_lpos") < depth
    # Like SQL SUM: null when every value in the window is null.
    any_value = (F.count(v).over(fr) + F.size(F.filter(extra, lambda x: x.isNotNull()))) > 0
    total = F.when(near, F.when(any_value, F.coalesce(local_sum, zero) + extra_sum)) \
             .otherwise(local_sum)
    if cast:
        total = total.cast(cast)
    n = F.when(near, local_n + F.size(extra)).otherwise(local_n)
    res = frame.withColumns({out_sum: total, out_n: n.cast("long")})
    return res.drop("_pre", "_lpos", "_rpos", SEG, KEY, RID)


def periodic_phase(df: DataFrame, keys, order, period: int, out: str = "phase",
                   partitions: int | None = None) -> DataFrame:
    """Phase of the time index within a fixed period: ``pmod(position, period)``."""
    res = with_position(df, keys, order, out="_phase_pos", partitions=partitions)
    return res.withColumn(out, F.pmod(F.col("_phase_pos"), F.lit(period))).drop("_phase_pos")


def row_range(df: DataFrame, keys, order, start: int, stop: int, out: str = "pos",
              partitions: int | None = None) -> DataFrame:
    """Rows whose 0-based series position lies in ``[start, stop]`` (inclusive)."""
    res = with_position(df, keys, order, out=out, partitions=partitions)
    return res.where(F.col(out).between(start, stop))


def rows_at_max(df: DataFrame, value: str, groups: Sequence[str] = ()) -> DataFrame:
    """All rows whose ``value`` equals the maximum of their group (ties kept).

    The maximum is a partial (map-side) aggregate, so a hot group costs one row per
    task in the shuffle; the join back is planned by Catalyst/AQE on the tiny side.
    """
    groups = _cols(groups)
    mx = df.groupBy(*groups).agg(F.max(value).alias("_mx"))
    if not groups:
        # One-row aggregate: a proven size bound, so a broadcast is always safe.
        return (df.join(F.broadcast(mx), F.col(value) == F.col("_mx"), "left_semi"))
    cond = [df[g].eqNullSafe(mx[g]) for g in groups] + [df[value] == mx["_mx"]]
    return df.join(mx, cond, "left_semi")
