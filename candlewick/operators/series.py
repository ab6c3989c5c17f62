"""Layouts that turn a keyed, ordered table into window-ready partitions.

Two layouts share every indicator below them:

``whole``    one window partition per key. Only for tables with at most one row
             per key and calendar day, whose series cannot outgrow the calendar.
``blocked``  a series of any length is cut into row blocks, each carrying a copy
             of the rows just before it (the halo). One hot key then spreads
             over the cluster, and a window frame up to the halo's length sees
             exactly the rows it would see in the uncut series.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

RN = "_rn"  # zero-based position in the whole series
BLK = "_blk"
HALO = "_halo"
GRAIN = "_grain"
BLOCK_ROWS = 1 << 16
CELL_ROWS = 1 << 20  # rows one task may sort to number them


@dataclass(frozen=True)
class Series:
    """A laid-out table: ``parts`` is what windows partition by."""

    df: DataFrame
    key: tuple[str, ...]
    order: tuple[str, ...]
    parts: tuple[str, ...]
    lookback: int | None = None  # rows of history each block sees; None = all of it
    block_rows: int | None = None
    # Window specifications by frame start, built once and shared by later steps.
    specs: dict[int | None, WindowSpec] = field(default_factory=dict, compare=False, repr=False)

    @property
    def ordered(self) -> WindowSpec:
        if None not in self.specs:
            self.specs[None] = Window.partitionBy(*self.parts).orderBy(RN)
        return self.specs[None]

    @property
    def upto(self) -> WindowSpec:
        return self._from(Window.unboundedPreceding)

    def last(self, n: int) -> WindowSpec:
        """Frame of the current row and the n - 1 before it."""
        self.need(n - 1)
        return self._from(1 - n)

    def _from(self, start: int) -> WindowSpec:
        if start not in self.specs:
            self.specs[start] = self.ordered.rowsBetween(start, Window.currentRow)
        return self.specs[start]

    def need(self, rows: int) -> None:
        if self.lookback is not None and rows > self.lookback:
            raise ValueError(f"needs {rows} rows of history, blocks carry {self.lookback}")

    def add(self, columns: dict[str, Column]) -> Series:
        return replace(self, df=self.df.withColumns(columns))

    def drop(self, *columns: str) -> Series:
        return replace(self, df=self.df.drop(*columns))

    @property
    def position(self) -> Column:
        """Row number counted from the start of the block (negative in its halo)."""
        if self.block_rows is None:
            return F.col(RN)
        return F.col(RN) - F.col(BLK) * self.block_rows

    def rows(self, *drop: str) -> DataFrame:
        """The original rows, without halo copies and layout columns."""
        df = self.df if self.lookback is None else self.df.filter(~F.col(HALO))
        return df.drop(RN, BLK, HALO, *drop)


def whole(df: DataFrame, key: str = "symbol", order: str = "d") -> Series:
    """Layout for calendar-keyed tables, unique on (key, order)."""
    kind = dict(df.dtypes)[order]
    if kind != "date":
        raise ValueError(f"whole() orders by a date column, {order} is {kind}: use blocked()")
    pos = F.row_number().over(Window.partitionBy(key).orderBy(order)) - 1
    return Series(df.withColumn(RN, pos.cast("long")), (key,), (order,), (key,))


def _offsets(counts: DataFrame, key: list[str], levels: list[str]) -> DataFrame:
    """Rows that come before each cell, from the counts per nested cell."""
    outer = [*key, *levels[:-1]]
    before = (
        Window.partitionBy(*outer)
        .orderBy(levels[-1])
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    inside = counts.withColumn("_offset", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    if len(levels) == 1:
        return inside.drop("_n")
    totals = counts.groupBy(*outer).agg(F.sum("_n").alias("_n"))
    base = _offsets(totals, key, levels[:-1]).withColumnRenamed("_offset", "_base")
    return inside.join(base, outer).select(
        *outer, levels[-1], (F.col("_base") + F.col("_offset")).alias("_offset")
    )


def number_rows(
    df: DataFrame, key: Sequence[str], order: Sequence[str], grains: Sequence[Column]
) -> DataFrame:
    """Add the zero-based position of each row in its series, without a per-key sort.

    ``grains`` are integers that never decrease along the order, coarse to fine (an
    hour number, then a second number). Rows are counted per cell; running totals
    of those counts, level by level, give each cell its offset, and rows are only
    sorted inside one finest cell. Neither a hot key nor a hot hour meets in one
    task, and the sort and the offset join share one shuffle.
    """
    levels = [f"{GRAIN}{i}" for i in range(len(grains))]
    cells = [*key, *levels]
    df = df.withColumns({n: g.cast("long") for n, g in zip(levels, grains)})
    counts = df.groupBy(*cells).agg(F.count(F.lit(1)).alias("_n"))
    local = F.row_number().over(Window.partitionBy(*cells).orderBy(*order)) - 1
    return (
        df.withColumn("_local", local)
        .join(_offsets(counts, list(key), levels), cells)
        .withColumn(RN, F.col("_offset") + F.col("_local"))
        .drop("_offset", "_local", *levels)
    )


def time_grains(df: DataFrame, key: Sequence[str], ts: str) -> list[Column]:
    """Hours as cells if none is too full to sort in one task, else hours and seconds.

    Costs one counting pass over the key and time columns; the second level would
    cost an extra join on every row.
    """
    second = F.unix_seconds(ts)
    hour = F.floor(second / 3600)
    busiest = df.groupBy(*key, hour).count().agg(F.max("count")).first()[0] or 0
    return [hour] if busiest <= CELL_ROWS else [hour, second]


def blocked(
    df: DataFrame,
    key: Sequence[str] = ("symbol",),
    order: Sequence[str] = ("ts", "event_id"),
    grains: Sequence[Column] | None = None,
    lookback: int = 256,
    block_rows: int = BLOCK_ROWS,
) -> Series:
    """Layout for series of any length; ``order`` must be total within a key."""
    if lookback > block_rows:
        raise ValueError("a block must be at least as long as its halo")
    if grains is None:
        grains = time_grains(df, key, order[0])
    df = number_rows(df, key, order, grains)
    blk = F.expr(f"{RN} div {block_rows}")
    own = F.struct(blk.alias(BLK), F.lit(False).alias(HALO))
    copy = F.struct((blk + 1).alias(BLK), F.lit(True).alias(HALO))
    tail = F.col(RN) % block_rows >= block_rows - lookback
    df = df.withColumn("_place", F.explode(F.when(tail, F.array(own, copy)).otherwise(F.array(own))))
    df = df.withColumns({BLK: F.col("_place")[BLK], HALO: F.col("_place")[HALO]}).drop("_place")
    return Series(df, tuple(key), tuple(order), (*key, BLK), lookback, block_rows)


def _block_state(s: Series, summary: dict[str, Column], carry: dict[str, Column]) -> DataFrame:
    """Per block: ``summary`` aggregates, then ``carry`` over the earlier blocks."""
    return (
        s.df.filter(~F.col(HALO)).groupBy(*s.parts).agg(*[c.alias(n) for n, c in summary.items()])
    ).select(*s.parts, *[c.alias(n) for n, c in carry.items()])


def running_sums(s: Series, sums: dict[str, Column]) -> Series:
    """Cumulative sums from the start of the series."""
    if s.lookback is None:
        return s.add({n: F.sum(c).over(s.upto) for n, c in sums.items()})
    earlier = (
        Window.partitionBy(*s.key).orderBy(BLK).rowsBetween(Window.unboundedPreceding, -1)
    )
    state = _block_state(
        s,
        {f"_t_{n}": F.sum(c) for n, c in sums.items()},
        {f"_o_{n}": F.coalesce(F.sum(f"_t_{n}").over(earlier), F.lit(0.0)) for n in sums},
    )
    local = {n: F.sum(F.when(~F.col(HALO), c)).over(s.upto) for n, c in sums.items()}
    df = s.df.withColumns(local).join(state, list(s.parts), "left")
    df = df.withColumns({n: F.col(n) + F.col(f"_o_{n}") for n in sums})
    return replace(s, df=df.drop(*[f"_o_{n}" for n in sums]))


def forward_fill(s: Series, columns: Sequence[str]) -> Series:
    """Replace NULLs by the last known value of the series.

    Exact on every row of a block and on the halo row just before it, which is
    what a one-step lag reads.
    """
    if s.lookback is None:
        return s.add({c: F.last(c, ignorenulls=True).over(s.upto) for c in columns})
    earlier = (
        Window.partitionBy(*s.key).orderBy(BLK).rowsBetween(Window.unboundedPreceding, -1)
    )
    known = {f"_k_{c}": F.max_by(c, F.when(F.col(c).isNotNull(), F.col(RN))) for c in columns}
    state = _block_state(
        s, known, {f"_c_{c}": F.last(f"_k_{c}", ignorenulls=True).over(earlier) for c in columns}
    )
    local = {c: F.last(c, ignorenulls=True).over(s.upto) for c in columns}
    df = s.df.withColumns(local).join(state, list(s.parts), "left")
    df = df.withColumns({c: F.coalesce(F.col(c), F.col(f"_c_{c}")) for c in columns})
    return replace(s, df=df.drop(*[f"_c_{c}" for c in columns]))


def first_values(s: Series, columns: Sequence[str]) -> Series:
    """Attach the value of the series' first row as ``first_<column>``."""
    names = {c: f"first_{c}" for c in columns}
    if s.lookback is None:
        return s.add({n: F.first(c).over(s.upto) for c, n in names.items()})
    # One row per block says how its series began, so rows join on their block, not on the key.
    upto = Window.partitionBy(*s.key).orderBy(BLK).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    state = _block_state(
        s,
        {f"_h_{c}": F.min_by(c, RN) for c in columns},
        {n: F.first(f"_h_{c}").over(upto) for c, n in names.items()},
    )
    return replace(s, df=s.df.join(state, list(s.parts), "left"))


@dataclass(frozen=True)
class Recurrence:
    """y[t] = decay * y[t-1] + drive[t], with y[-1] = 0."""

    name: str
    drive: Column
    decay: float


# Weight below which older blocks no longer reach a double's last bit, and the
# largest power of ten the scaled sums may reach.
FADE = 1e-18
HEADROOM = 260.0


def _block_length(decay: float) -> int:
    return max(2, math.ceil(math.log(FADE) / math.log(decay)))


def share_blocks(recs: Sequence[Recurrence]) -> list[tuple[int, list[Recurrence]]]:
    """Group recurrences that can use one block length, hence one sort."""
    groups: list[tuple[int, list[Recurrence]]] = []
    for rec in sorted(recs, key=lambda r: -r.decay):
        for length, members in groups:
            if -length * math.log10(rec.decay) <= HEADROOM:
                members.append(rec)
                break
        else:
            groups.append((_block_length(rec.decay), [rec]))
    return groups


def recurrences(s: Series, recs: Sequence[Recurrence]) -> Series:
    """Evaluate linear recurrences as scaled window sums.

    Positions are cut into scan blocks of L rows, L long enough that decay**L is
    negligible. Inside a block, y = decay**p * sum(drive * decay**-p); the block
    before adds decay**(p+1) times its last value, and anything older is below
    double precision. Everything stays in built-in window sums: recurrences that
    share a block length share one sort, and no extra shuffle is needed because
    the scan blocks nest inside ``parts``.
    """
    for length, members in share_blocks(recs):
        s.need(2 * length)
        c, p = f"_c{length}", F.col(RN) % length
        s = s.add({c: F.expr(f"{RN} div {length}")})
        inside = (
            Window.partitionBy(*s.parts, c)
            .orderBy(RN)
            .rowsBetween(Window.unboundedPreceding, Window.currentRow)
        )
        s = s.add(
            {
                f"_l_{r.name}": F.pow(F.lit(r.decay), p)
                * F.sum(r.drive * F.pow(F.lit(r.decay), -p)).over(inside)
                for r in members
            }
        )
        previous = Window.partitionBy(*s.parts).orderBy(c).rangeBetween(-1, -1)
        at_end = p == length - 1
        s = s.add(
            {
                r.name: F.col(f"_l_{r.name}")
                + F.coalesce(
                    F.max(F.when(at_end, F.col(f"_l_{r.name}"))).over(previous), F.lit(0.0)
                )
                * F.pow(F.lit(r.decay), p + 1)
                for r in members
            }
        )
        s = replace(s, df=s.df.drop(c, *[f"_l_{r.name}" for r in members]))
    return s


def seeded(values: Column, decay: float) -> Column:
    """Drive of an exponential mean whose first value is the seed."""
    return F.when(F.col(RN) == 0, values).otherwise(values * (1.0 - decay))


# Decades a run of decaying weights may span in one scan block, and those after which the past is gone.
DECADES, GONE = 100, 18


def _slowest_fade(alpha: float) -> float:
    """Decay per row of the spacing of known values that forgets most slowly."""
    keep = 1.0 - alpha
    return max((keep**g / (keep**g + alpha)) ** (1 / g) for g in range(1, 4097))


def gap_means(s: Series, means: dict[str, tuple[str, float]]) -> Series:
    """Exponential means over columns with NULLs: name -> (column, alpha).

    A NULL keeps its place: it adds nothing and the mean before it stays, but the weight of
    the past fades with every row. A value g rows after the one before it then gives
    (f y + alpha x) / (f + alpha) with f = (1 - alpha)^g, an affine step y -> a y + b x
    whose a and b depend on the gap alone. So weights are one running sum of log a, and values
    one window sum scaled by it. The scan is cut where the weights have spanned ``DECADES``;
    only the cut before can still reach a row. Rows before the first value have no mean.
    """
    for name, (column, alpha) in means.items():
        s.need(math.ceil(-GONE * math.log(10) / math.log(_slowest_fade(alpha))))
        log_keep = math.log10(1.0 - alpha)
        x, known = F.col(column).cast("double"), F.col(column).isNotNull()
        before = s.ordered.rowsBetween(Window.unboundedPreceding, -1)
        gap = F.col(RN) - F.max(F.when(known, F.col(RN))).over(before)
        s = s.add({"_gap": gap})
        total = F.pow(F.lit(1.0 - alpha), F.col("_gap")) + alpha
        log_a = F.greatest(F.col("_gap") * log_keep - F.log10(total), F.lit(-float(GONE)))
        s = s.add(
            {
                "_b": F.when(known, F.coalesce(alpha / total, F.lit(1.0)) * x),
                "_cum": F.coalesce(F.sum(F.when(known, log_a)).over(s.upto), F.lit(0.0)),
            }
        )
        s = s.add({"_cut": F.floor(-F.col("_cum") / DECADES)})
        span = F.col("_cum") + DECADES * F.col("_cut")
        inside = (
            Window.partitionBy(*s.parts, "_cut")
            .orderBy(RN)
            .rowsBetween(Window.unboundedPreceding, Window.currentRow)
        )
        s = s.add({"_local": F.pow(F.lit(10.0), span) * F.sum(F.col("_b") * F.pow(F.lit(10.0), -span)).over(inside)})
        previous = Window.partitionBy(*s.parts).orderBy("_cut").rangeBetween(-1, -1)
        reach = F.col("_cum") - F.min("_cum").over(previous)
        carried = F.pow(F.lit(10.0), reach) * F.max_by("_local", RN).over(previous)
        mean = F.col("_local") + F.coalesce(carried, F.lit(0.0))
        if s.lookback is not None:
            # Before its first own value a block holds what the block before has computed: the
            # last value in the halo may stand at its far end, without history.
            own = F.max(F.when(known, F.col(RN))).over(s.upto) >= F.col(BLK) * s.block_rows
            mean = F.when(own, mean)
        s = s.add({name: mean}).drop("_gap", "_b", "_cum", "_cut", "_local")
    return s if s.lookback is None else forward_fill(s, list(means))
