"""Resampling that serves many hypotheses at once.

A draw permutes the values of each date once; every hypothesis reads its sums
off the same permutation, as a product of the permuted values and the date's
matrix of hits.  So the draws cost the same for one hypothesis and for hundreds,
and those of a family hang together, which its largest statistic needs.
Bootstraps draw dates once for all hypotheses, too.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import seeds

PRIME = (1 << 31) - 1
CELLS = 1 << 18  # keys held at once: what stays in a processor's cache
SLACK = 1e-9


def _reduced(x):
    """x modulo PRIME for x of 0 to below 2^62, without a division."""
    x = (x & PRIME) + (x >> 31)
    x = (x & PRIME) + (x >> 31)
    return x - PRIME * (x >= PRIME)


def _fifth(x):
    """Fifth powers modulo PRIME: one number for each, as 5 does not divide PRIME - 1."""
    square = _reduced(x * x)
    return _reduced(_reduced(square * square) * x)


def order_keys(seed: int, draws: np.ndarray, day: int, secs: np.ndarray) -> np.ndarray:
    """What orders the securities of a day in each draw: (draws, securities), from whole numbers that SQL has, too."""
    secs, draws = secs % PRIME * 48271 % PRIME, draws[:, None]
    first = _fifth(_reduced(secs + (draws * 69621 + (day * 16807 + seed * 39373)) % PRIME))
    return _fifth(_reduced(first + (draws * 40692 + day * 30269 + seed) % PRIME))


def orders(keys: np.ndarray) -> np.ndarray:
    """Each row's stable order: places are packed below the keys, which are less than 2^31, so that plain numbers are sorted."""
    bits = int(keys.shape[1]).bit_length()
    return np.sort(keys << bits | np.arange(keys.shape[1]), axis=1) & ((1 << bits) - 1)


def order_keys_sql(source: str, seed: int) -> str:
    """``source`` (draw, d, sec, ...) with ``key``, as :func:`order_keys` has it."""
    day = "(d - DATE '1970-01-01')"
    first = f"(sec % {PRIME} * 48271 + draw * 69621 + {day} * 16807 + {seed * 39373}) % {PRIME}"
    second = f"(s1 * s1 % {PRIME} * x1 % {PRIME} + draw * 40692 + {day} * 30269 + {seed}) % {PRIME}"
    return f"""(SELECT * EXCLUDE (x1, s1, x2, s2), s2 * s2 % {PRIME} * x2 % {PRIME} AS key FROM (SELECT *, x2 * x2 % {PRIME} AS s2 FROM (SELECT *, {second} AS x2 FROM
  (SELECT *, x1 * x1 % {PRIME} AS s1 FROM (SELECT *, {first} AS x1 FROM {source})))))"""


def permutations(panel: DataFrame, draws: int, seed: int) -> DataFrame:
    """One row per hypothesis and draw: ``hyp, draw, dates, drawn, observed``.

    ``panel`` has d, sec (whole numbers, once a date), value and hyps, an array
    of the hypotheses that the row is an event of.  The statistic is the mean
    over dates of the events' mean less the others'; dates without either are
    left out of a hypothesis.  A draw gives each date's values to its
    securities anew.  Rows without a value take no part.  A task holds the
    securities of one date and a sum for each hypothesis and draw.
    """
    dates = panel.where("value is not null").groupBy(F.unix_date("d").alias("day")).agg(F.collect_list(F.struct("sec", "value", "hyps")).alias("rows"))

    def run(batches):
        null, seen = {}, {}
        for batch in batches:
            for day, rows in zip(batch.column("day").to_pylist(), batch.column("rows"), strict=True):
                one = rows.values.flatten()
                order = np.argsort(one[0].to_numpy(), kind="stable")
                sec, value = one[0].to_numpy()[order], one[1].to_numpy()[order]
                names: dict[str, int] = {}
                place = [(k, names.setdefault(h, len(names))) for k, r in enumerate(order.tolist()) for h in set(one[2][r].as_py() or ())]
                if not place:
                    continue
                hits = np.zeros((len(sec), len(names)))
                hits[tuple(np.array(place).T)] = 1.0
                size, total, n = hits.sum(0), value.sum(), len(sec)
                for name, c in names.items():
                    if size[c] < n:
                        null.setdefault(name, np.zeros(draws))
                        held = seen.setdefault(name, [0.0, 0])
                        mine = value @ hits[:, c]
                        held[0] += mine / size[c] - (total - mine) / (n - size[c])
                        held[1] += 1
                used = [(name, c) for name, c in names.items() if size[c] < n]
                step = max(1, CELLS // n)
                for at in range(0, draws if used else 0, step):
                    some = np.arange(at, min(draws, at + step))
                    mixed = value[orders(order_keys(seed, some, day, sec))] @ hits
                    for name, c in used:
                        null[name][some] += mixed[:, c] / size[c] - (total - mixed[:, c]) / (n - size[c])
        for name, sums in null.items():
            observed, dates_n = seen[name]
            columns = [pa.array([name] * draws, pa.string()), pa.array(np.arange(draws)), pa.array(sums), pa.array(np.full(draws, observed)), pa.array(np.full(draws, dates_n))]
            yield pa.RecordBatch.from_arrays(columns, names=["hyp", "draw", "drawn", "observed", "n"])

    sums = dates.mapInArrow(run, "hyp string, draw long, drawn double, observed double, n long").groupBy("hyp", "draw")
    return sums.agg(F.sum("n").alias("dates"), (F.sum("drawn") / F.sum("n")).alias("drawn"), (F.sum("observed") / F.sum("n")).alias("observed"))


def permutation_p(drawn: DataFrame) -> DataFrame:
    """One row per hypothesis: ``hyp, dates, perm_n, observed, p_upper, p_lower, p_two_sided, p_family``.

    ``perm_n`` counts the draws there are; p values count the observed one
    among them.  ``p_family`` compares the statistic, in deviations of its own
    draws, with the largest of the family in each draw.
    """
    own = Window.partitionBy("hyp")
    sd = F.stddev_pop("drawn").over(own)
    scaled = lambda c: F.when(sd > 1e-15, (F.col(c) - F.avg("drawn").over(own)) / sd)
    z = drawn.withColumn("z", scaled("drawn")).withColumn("z_observed", scaled("observed"))
    z = z.withColumn("top", F.max("z").over(Window.partitionBy("draw")))
    share = lambda reached: (F.count_if(reached) + 1) / (F.count(F.lit(1)) + 1)
    observed = F.col("observed")
    out = z.groupBy("hyp").agg(
        F.max("dates").alias("dates"), F.count(F.lit(1)).alias("perm_n"), F.max("observed").alias("observed"), share(F.col("drawn") >= observed - SLACK).alias("p_upper"),
        share(F.col("drawn") <= observed + SLACK).alias("p_lower"), share(F.col("top") >= F.col("z_observed") - SLACK).alias("p_family"),
    )
    return out.withColumn("p_two_sided", F.least(F.lit(1.0), 2 * F.least("p_upper", "p_lower")))


def permutation_sql(rows: str, hits: str, draws: int, seed: int) -> str:
    """CTEs that end in ``perm``, of ``rows`` (d, sec, value) and ``hits`` (hyp, d, sec)."""
    return f"""pr AS MATERIALIZED (SELECT d, sec, value, row_number() OVER (PARTITION BY d ORDER BY sec) AS i, count(*) OVER (PARTITION BY d) AS n, sum(value) OVER (PARTITION BY d) AS total FROM {rows} WHERE value IS NOT NULL),
ph AS MATERIALIZED (SELECT hyp, d, i, n, total, value, count(*) OVER (PARTITION BY hyp, d) AS k FROM {hits} JOIN pr USING (d, sec)),
pw AS (SELECT draw, d, value AS mixed, row_number() OVER (PARTITION BY draw, d ORDER BY key, sec) AS i FROM {order_keys_sql(f'(SELECT draw, d, sec, value FROM pr, range({draws}) t(draw))', seed)}),
ps AS (SELECT hyp, draw, ph.d, sum(mixed) / k - (total - sum(mixed)) / (n - k) AS s FROM ph JOIN pw USING (d, i) WHERE k < n GROUP BY hyp, draw, ph.d, k, n, total),
pobs AS (SELECT hyp, avg(s) AS observed, count(*) AS dates FROM (SELECT hyp, d, sum(value) / k - (total - sum(value)) / (n - k) AS s FROM ph WHERE k < n GROUP BY hyp, d, k, n, total) GROUP BY hyp),
pn AS MATERIALIZED (SELECT hyp, draw, avg(s) AS drawn FROM ps GROUP BY 1, 2),
pz AS (SELECT pn.*, observed, dates, CASE WHEN stddev_pop(drawn) OVER w > 1e-15 THEN (drawn - avg(drawn) OVER w) / stddev_pop(drawn) OVER w END AS z, CASE WHEN stddev_pop(drawn) OVER w > 1e-15 THEN (observed - avg(drawn) OVER w) / stddev_pop(drawn) OVER w END AS z_observed FROM pn JOIN pobs USING (hyp) WINDOW w AS (PARTITION BY hyp)),
pt AS (SELECT *, max(z) OVER (PARTITION BY draw) AS top FROM pz),
perm AS MATERIALIZED (SELECT hyp, max(dates) AS dates, count(*) AS perm_n, max(observed) AS observed, (count(*) FILTER (WHERE drawn >= observed - {SLACK}) + 1) / (count(*) + 1) AS p_upper, (count(*) FILTER (WHERE drawn <= observed + {SLACK}) + 1) / (count(*) + 1) AS p_lower,
  (count(*) FILTER (WHERE top >= z_observed - {SLACK}) + 1) / (count(*) + 1) AS p_family FROM pt GROUP BY hyp)"""


def bootstrap(daily: DataFrame, draws: int, seed: int) -> DataFrame:
    """``hyp, boot_n, ci_lower, ci_upper``: 95 % intervals of the mean of a hypothesis's daily values (hyp, d, value).

    A draw takes as many dates as the calendar has, with replacement, the same
    for all hypotheses; those without a value on a date pass over it.  The
    calendar is numbered in one place (a row a date) and is the small side.
    """
    days = daily.select("d").distinct()
    one = Window.partitionBy(F.lit(1))
    numbered = days.select("d", (F.row_number().over(one.orderBy("d")) - 1).alias("i"), F.count(F.lit(1)).over(one).alias("n"))
    grid = daily.sparkSession.range(draws).withColumnRenamed("id", "draw").crossJoin(F.broadcast(numbered.agg(F.max("n").alias("n"))))  # one row
    taken = grid.where("n > 0").select("draw", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("turn"))
    times = taken.groupBy("draw", F.floor(seeds.uniform(seed, "draw", "turn") * F.col("n")).alias("i")).agg(F.count(F.lit(1)).alias("times"))
    values = daily.where("value is not null").join(F.broadcast(numbered.select("d", "i")), "d").select("hyp", "i", "value")
    means = times.join(values, "i").groupBy("hyp", "draw").agg((F.sum(F.col("times") * F.col("value")) / F.sum("times")).alias("mean"))
    return means.groupBy("hyp").agg(F.count(F.lit(1)).alias("boot_n"), F.percentile("mean", 0.025).alias("ci_lower"), F.percentile("mean", 0.975).alias("ci_upper"))


def bootstrap_sql(daily: str, draws: int, seed: int) -> str:
    """CTEs that end in ``boot``, of ``daily`` (hyp, d, value)."""
    return f"""bd AS MATERIALIZED (SELECT d, row_number() OVER (ORDER BY d) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT d FROM {daily})),
bt AS MATERIALIZED (SELECT draw, floor({seeds.uniform_sql(seed, 'draw', 'turn')} * n)::BIGINT AS i, count(*) AS times FROM range({draws}) a(draw), (SELECT i AS turn, n FROM bd) GROUP BY 1, 2),
bm AS (SELECT hyp, draw, sum(times * value) / sum(times) AS mean FROM bt JOIN bd USING (i) JOIN {daily} USING (d) WHERE value IS NOT NULL GROUP BY 1, 2),
boot AS MATERIALIZED (SELECT hyp, count(*) AS boot_n, quantile_cont(mean, 0.025) AS ci_lower, quantile_cont(mean, 0.975) AS ci_upper FROM bm GROUP BY hyp)"""
