"""Time-decayed features over strictly earlier rows.

A row aged `a` weighs 2^(-a/H). Time is cut into stretches of STRETCH half-lives. Inside a stretch the
weight is 2^(t/H) from the stretch's start, which turns a decayed sum into a plain prefix sum and stays within a double; what
earlier stretches leave is a pair (stretch, sum scaled to its start), and pairs merge by scaling the earlier one
with 2^(-gap/H). So neither the span of time nor its origin is limited, and a mean outlives its weights: where all of them
have faded, their ratio is still that of the latest stretch. Missing measures add to neither
side, but the clock keeps running through them.
"""
from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from priorlake.operators.prefix import Block, prior_sums

STRETCH = 256.0  # half-lives (of the shortest one in use); doubles hold 1023


@dataclass(frozen=True)
class Exponential:
    """One half-life."""

    halflife: float

    def parts(self) -> list[tuple[float, float]]:
        return [(1.0, self.halflife)]


@dataclass(frozen=True)
class TwoTimescale:
    """A fast and a slow half-life; `weight_fast` is the fast share at age zero."""

    fast: float
    slow: float
    weight_fast: float

    def __post_init__(self):
        if not 0.0 <= self.weight_fast <= 1.0:
            raise ValueError(f"weight_fast must lie in [0, 1], got {self.weight_fast}")
        if self.fast >= self.slow:
            raise ValueError(f"the fast half-life must be the shorter one, got {self.fast} >= {self.slow}")

    def parts(self) -> list[tuple[float, float]]:
        return [(self.weight_fast, self.fast), (1.0 - self.weight_fast, self.slow)]


Kernel = Exponential | TwoTimescale


@dataclass(frozen=True)
class RecencyPlan:
    """Which kernel governs which measure; `anchor` is "current" or "previous"."""

    default: Kernel
    per_measure: dict[str, Kernel] = field(default_factory=dict)
    anchor: str = "current"

    def kernel(self, measure: str) -> Kernel:
        return self.per_measure.get(measure, self.default)


def growth(clock: Column, halflife: float, origin: float | Column) -> Column:
    """2^((clock - origin)/H) for spans that a double holds."""
    return F.pow(F.lit(2.0), (clock - origin) / F.lit(float(halflife)))


def decayed_prior(
    df: DataFrame,
    keys: list[str],
    t: str,
    pairs: dict[str, tuple[Column, Column]],
    kernels: dict[str, Kernel] | Kernel,
    *,
    mask: Column | None = None,
    anchor: str = "current",
    clock: str | None = None,
    block: Block | None = None,
) -> DataFrame:
    """One row per (keys, t): `<name>` = decayed num/den and `<name>_n` = decayed den.

    pairs   name -> (numerator, denominator); null parts contribute nothing
    mask    rows that may feed later rows (all of them receive a value)
    clock   column the decay runs on when it differs from the order `t`; it must not fall as `t` rises
    anchor  "previous" measures age from the key's previous time instead of `t`
    """
    if anchor not in ("current", "previous"):
        raise ValueError(f"anchor must be 'current' or 'previous', got {anchor!r}")
    kernel_of = kernels.__getitem__ if isinstance(kernels, dict) else lambda _name: kernels
    use = F.lit(True) if mask is None else F.coalesce(mask, F.lit(False))
    halves = {f"{name}__{i}": half for name in pairs for i, (_, half) in enumerate(kernel_of(name).parts())}
    width = F.lit(STRETCH * min(halves.values()))
    start = F.col("_stretch") * width
    tick = F.col(clock or t).cast("double")
    sums = {"_at": tick}
    for name, (num, den) in pairs.items():
        sums |= {f"{name}__n": F.when(use, num), f"{name}__d": F.when(use, den)}
    plain = [c for c in sums if c != "_at"]
    per_time = df.groupBy(*keys, t).agg(F.max(tick).alias("_at"), *[F.sum(sums[c]).alias(c) for c in plain])
    per_time = per_time.withColumn("_stretch", F.floor(F.col("_at") / width))
    scaled = {f"{p}{k}": F.col(f"{p.rsplit('__', 1)[0]}__{k}") * growth(F.col("_at"), half, start) for p, half in halves.items() for k in "nd"}
    over = Window.partitionBy(*keys).orderBy(t)
    if block is None:
        inside = Window.partitionBy(*keys, "_stretch").orderBy(t).rowsBetween(Window.unboundedPreceding, -1)
        rows = per_time.select(*keys, t, "_at", "_stretch", *[c.alias(n) for n, c in scaled.items()], F.lead("_stretch").over(over).alias("_later"))
        last = F.col("_later").isNull() | (F.col("_later") != F.col("_stretch"))
        prior = {n: F.coalesce(F.sum(n).over(inside), F.lit(0.0)) for n in scaled}
        total = F.struct("_stretch", *[(prior[n] + F.coalesce(n, F.lit(0.0))).alias(n) for n in scaled])
        history = rows.select(*keys, t, "_at", "_stretch", *[prior[n].alias(n) for n in scaled], F.when(last, total).alias("_total"))
        before = Window.partitionBy(*keys).orderBy("_stretch").rangeBetween(Window.unboundedPreceding, -1)
        history = history.withColumn("_carry", F.collect_list("_total").over(before)).drop("_total")
    else:
        rows = per_time.select(*keys, t, "_at", "_stretch", *[c.alias(n) for n, c in scaled.items()])
        history = prior_sums(rows, [*keys, "_stretch"], t, {n: F.col(n) for n in scaled}, block=block)
        history = history.join(rows.select(*keys, t, "_at"), [*keys, t])
        total = rows.groupBy(*keys, "_stretch").agg(*[F.coalesce(F.sum(n), F.lit(0.0)).alias(n) for n in scaled])
        before = Window.partitionBy(*keys).orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
        carry = total.select(*keys, "_stretch", F.collect_list(F.struct("_stretch", *scaled)).over(before).alias("_carry"))
        history = history.join(carry, [*keys, "_stretch"])
    if anchor == "previous":
        history = history.withColumn("_at", F.coalesce(F.lag("_at").over(over), F.col("_at")))
    none = F.struct(F.lit(None).cast("long").alias("s"), F.lit(0.0).alias("n"), F.lit(0.0).alias("d"))

    def merged(p: str, half: float) -> Column:
        """What all earlier stretches leave of a part: (stretch it is scaled to, numerator, denominator)."""
        fade = lambda acc, x: F.coalesce(F.pow(F.lit(2.0), (acc["s"] - x["_stretch"]) * width / half), F.lit(0.0))
        add = lambda acc, x: F.when(
            (x[f"{p}d"] != 0) | (x[f"{p}n"] != 0),
            F.struct(x["_stretch"].alias("s"), (x[f"{p}n"] + acc["n"] * fade(acc, x)).alias("n"), (x[f"{p}d"] + acc["d"] * fade(acc, x)).alias("d")),
        ).otherwise(acc)
        return F.aggregate("_carry", none, add)

    # An empty carry is the rule: a stretch is longer than most histories.
    history = history.select(*[c for c in history.columns if c != "_carry"], *[F.when(F.size("_carry") > 0, merged(p, half)).alias(f"{p}c") for p, half in halves.items()])
    out = []
    for name in pairs:
        parts = []
        for i, (share, half) in enumerate(kernel_of(name).parts()):
            p = f"{name}__{i}"
            gap = F.coalesce((F.col("_stretch") - F.col(f"{p}c.s")) * width / half, F.lit(0.0))
            rest = lambda k: F.coalesce(F.col(f"{p}c.{k}"), F.lit(0.0))  # noqa: E731, B023
            own = F.col(f"{p}d") != 0
            value = {k: F.when(own, F.col(f"{p}{k}") + rest(k) * F.pow(F.lit(2.0), -gap)).otherwise(rest(k)) for k in "nd"}
            age = (F.col("_at") - start) / half + F.when(own, 0.0).otherwise(gap)
            parts.append((share, value["n"], value["d"], age))
        youngest = F.least(*[a for _, _, _, a in parts]) if len(parts) > 1 else parts[0][3]
        weight = lambda a: F.pow(F.lit(2.0), youngest - a) if len(parts) > 1 else F.lit(1.0)  # noqa: E731, B023
        num, den = (sum_of(F.lit(share) * (n if k == "n" else d) * weight(a) for share, n, d, a in parts) for k in "nd")
        out.append(F.when(den > 0, num / den).alias(name))
        out.append(sum_of(F.when(d != 0, F.lit(share) * d * F.pow(F.lit(2.0), -a)).otherwise(0.0) for share, _, d, a in parts).alias(f"{name}_n"))
    return history.select(*keys, t, *out)


def sum_of(columns) -> Column:
    total = None
    for c in columns:
        total = c if total is None else total + c
    return total


def prior_mean(
    df: DataFrame,
    keys: list[str],
    t: str,
    measures: dict[str, str],
    kernel: Kernel | dict[str, Kernel],
    **options,
) -> DataFrame:
    """`df` plus a decayed mean of strictly earlier rows per measure (output -> column)."""
    pairs = {
        out: (F.col(c).cast("double"), F.when(F.col(c).isNotNull(), F.lit(1.0))) for out, c in measures.items()
    }
    values = decayed_prior(df, keys, t, pairs, kernel, **options)
    return df.join(values.select(*keys, t, *measures), [*keys, t])


def prior_rate(
    df: DataFrame,
    keys: list[str],
    t: str,
    rates: dict[str, tuple[Column, Column]],
    kernel: Kernel,
    **options,
) -> DataFrame:
    """`df` plus, per rate, the decayed pooled rate and its effective denominator `<rate>_n`."""
    zero = F.lit(0.0)
    pairs = {n: (F.coalesce(a.cast("double"), zero), F.coalesce(b.cast("double"), zero)) for n, (a, b) in rates.items()}
    values = decayed_prior(df, keys, t, pairs, kernel, **options)
    return df.join(values, [*keys, t])


def shrink(rate: Column, n_eff: Column, prior: Column, k: float | Column) -> Column:
    """(n·rate + k·prior)/(n + k); no evidence returns the prior itself."""
    k = F.lit(k) if isinstance(k, (int, float)) else k
    return (n_eff * F.coalesce(rate, F.lit(0.0)) + k * prior) / (n_eff + k)


def shrunk_prior_rate(
    df: DataFrame,
    entity: str,
    t: str,
    rates: dict[str, tuple[Column, Column]],
    k: dict[str, float],
    kernel: Kernel,
    **options,
) -> DataFrame:
    """Entity rates pulled toward the all-entity rate of the same strictly earlier rows.

    The pooled prior is one row per time, so its unpartitioned window sees as
    many rows as there are distinct times.
    """
    own = prior_rate(df, [entity], t, rates, kernel, **options)
    zero = F.lit(0.0)
    pairs = {n: (F.coalesce(a, zero), F.coalesce(b, zero)) for n, (a, b) in rates.items()}
    pooled = decayed_prior(df, [], t, pairs, kernel, **options)
    pooled = pooled.select(t, *[F.col(n).alias(f"{n}_pooled") for n in rates])
    joined = own.join(pooled, [t])
    for n in rates:
        joined = joined.withColumn(
            f"{n}_shrunk", shrink(F.col(n), F.col(f"{n}_n"), F.col(f"{n}_pooled"), k[n])
        )
    return joined


def effective_clock(df: DataFrame, keys: list[str], t: str, scheme: str, *, off_gap: int = 120, off_days: float = 45.0, unit: float = 7.0) -> DataFrame:
    """Distinct (keys, t) with `clock`: elapsed time along an alternative timeline.

    calendar    days
    compressed  days, but any gap of at least `off_gap` counts as `off_days`
    games       `unit` per step whatever its length
    """
    over = Window.partitionBy(*keys).orderBy(t)
    times = df.select(*keys, t).distinct()
    gap = F.coalesce(F.col(t) - F.lag(t).over(over), F.lit(0)).cast("double")
    step = {
        "calendar": gap,
        "compressed": F.when(gap < off_gap, gap).otherwise(F.lit(off_days)),
        "games": F.when(gap > 0, F.lit(unit)).otherwise(F.lit(0.0)),
    }.get(scheme)
    if step is None:
        raise ValueError(f"unknown timeline {scheme!r}")
    running = Window.partitionBy(*keys).orderBy(t).rowsBetween(Window.unboundedPreceding, 0)
    return times.withColumn("_step", step).select(*keys, t, F.sum("_step").over(running).alias("clock"))


def epoch_day(day: Column) -> Column:
    """Days since 1970-01-01 as an integer ordering column."""
    return F.datediff(day, F.lit("1970-01-01").cast("date"))


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))
