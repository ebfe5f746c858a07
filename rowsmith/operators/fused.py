"""Rule chains over a whole table with fused statistics.

A step moves a column by the score of another and needs whole-table statistics of both as they are when it
is applied. All of them follow from three sums per column (count, mean and squared deviations of its
numbers): filling missing values by a median or zero changes them by a formula, not by another scan. So a
chain is cut into *rounds*: a round ends before the first step that needs a column which a step of the
round has changed. At its start one pass over the chain's own columns writes them as they are then
(a few numbers a row, the only thing later rounds read) and collects, while it writes, the sums of every
column that a later step needs (``Dataset.observe``). A chain of k steps takes at most k passes, and
as many steps as do not feed each other share one.

The result is the input with one projection per step, statistics as literals: no join, no shuffle and one scan,
however many steps. If the input joins a parent (``attach_parent``), the join is run at the width of the
chain's columns for the first round and once more for the result.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, functions as F

from rowsmith.operators import correlate as C
from rowsmith.operators.constraints import as_double, constrain_col
from rowsmith.session import written

#: Ranks around the middle that the first pass brackets for medians, as a share of the rows.
MARGIN = 0.01


@dataclass(frozen=True)
class Sums:
    """Numbers of a column: rows in all, n numbers among them, their mean and summed squared deviations; for
    columns that a median may fill, values that bracket it."""

    rows: int
    n: int
    mean: float
    squares: float
    bracket: tuple[float, float] | None = None

    @property
    def missing(self) -> int:
        return self.rows - self.n

    def filled(self, value: float) -> Sums:
        """The sums if ``value`` stood where numbers are missing."""
        if not self.missing:
            return self
        mean = (self.n * self.mean + self.missing * value) / self.rows
        squares = self.squares + self.n * (self.mean - mean) ** 2 + self.missing * (value - mean) ** 2
        return Sums(self.rows, self.rows, mean, squares)

    @property
    def deviation(self) -> float:
        """Sample standard deviation, 0 where it is undefined."""
        return math.sqrt(self.squares / (self.n - 1)) if self.n > 1 else 0.0


def survey_columns(columns, brackets) -> dict[str, Column]:
    """The aggregates of a pass."""
    out = {"rows": F.count(F.lit(1))}
    for i, c in enumerate(columns):
        x = as_double(c)
        out |= {f"n{i}": F.count(x), f"mean{i}": F.avg(x), f"var{i}": F.var_pop(x)}
        if c in brackets:
            out[f"q{i}"] = F.percentile_approx(x, [0.5 - MARGIN, 0.5 + MARGIN], 10_000)
    return out


def read_survey(found: dict, columns, brackets) -> dict[str, Sums]:
    out = {}
    for i, c in enumerate(columns):
        n = found[f"n{i}"] or 0
        q = found.get(f"q{i}") if c in brackets else None
        out[c] = Sums(found["rows"], n, found[f"mean{i}"] or 0.0, (found[f"var{i}"] or 0.0) * n, tuple(q) if q else None)
    return out


def rounds(steps) -> list[int]:
    """The steps before which a pass is needed: the first, and each that needs a column changed since the last one."""
    out, changed = [], set()
    for k, s in enumerate(steps):
        if not out or needed([s]) & changed:
            out.append(k)
            changed = set()
        changed.add(s.field.name)
    return out


def needed(steps) -> set[str]:
    """Columns of which steps need sums."""
    return {s.field.name for s in steps if s.shape == "shift"} | {s.source for s in steps if not s.truth}


def step_column(df: DataFrame, step: C.Step, sums: dict[str, Sums], fill: float | None, draw: Column | None) -> Column:
    """The step's new target column, with its statistics as literals."""
    if step.truth:
        score = C.truthy(df, step.source)
    else:
        own = sums[step.source].filled(0.0)
        score = (F.coalesce(as_double(step.source), F.lit(0.0)) - F.lit(own.mean)) / F.lit(own.deviation) if own.deviation > 0 else F.lit(0.0)
    if step.shape == "logit":
        return draw < F.lit(1.0) / (F.lit(1.0) + F.exp(-F.greatest(F.lit(-4.0), F.least(F.lit(4.0), score * F.lit(step.weight)))))
    if step.shape == "line":
        return draw < F.greatest(F.lit(0.05), F.least(F.lit(0.95), F.lit(0.5) + F.lit(step.weight) * score))
    target, own = as_double(step.field.name), sums[step.field.name]
    if fill is not None:
        target, own = F.coalesce(target, F.lit(fill)), own.filled(fill)
    return constrain_col(step.field, target + F.lit(step.weight) * score * F.lit(own.deviation or 1.0), draw)


def apply_steps(df: DataFrame, steps: list[C.Step], draw_of: Callable[[str], Column], id_col: str,
                checkpoint_every: int = 0) -> DataFrame:
    """All steps in order, each seeing what those before it made of the whole table. ``draw_of`` gives the seeded draw
    of a name, from the column ``id_col``."""
    if not steps:
        return df
    names = list(dict.fromkeys(n for s in steps for n in (s.source, s.field.name)))
    if any(s.draw for s in steps):
        names.append(id_col)
    frame, starts = df.select(*[c for c in df.columns if c in names]), rounds(steps)
    sums: dict[str, Sums] = {}
    done: list[Callable[[DataFrame], DataFrame]] = []
    pending: list[Callable[[DataFrame], DataFrame]] = []
    for k, s in enumerate(steps):
        if k in starts:
            for move in pending:
                frame = move(frame)
            pending = []
            later = sorted(needed(steps[k:]))
            # a column that a step has filled has no missing values any more
            brackets = {t.field.name for t in steps[k:] if t.median} - {t.field.name for t in steps[:k]}
            asked = survey_columns(later, brackets)
            if k == starts[-1] and not brackets:
                found = frame.agg(*[a.alias(n) for n, a in asked.items()]).first().asDict()
            else:
                seen = Observation()
                frame = written(frame.observe(seen, *[a.alias(n) for n, a in asked.items()]), "chain")
                found = seen.get
            sums = read_survey(found, later, brackets)
        fill = None if s.keep else 0.0
        if s.median:
            own = sums[s.field.name]
            fill = C.whole_median(frame, s.field.name, own.n, own.bracket) if own.missing else None
        move = _move(s, sums, fill, draw_of(s.draw) if s.draw else None)
        pending.append(move)
        done.append(move)
    for k, move in enumerate(done):
        df = move(df)
        if checkpoint_every and (k + 1) % checkpoint_every == 0:
            df = df.checkpoint(eager=True)
    return df


def _move(step: C.Step, sums: dict[str, Sums], fill: float | None, draw: Column | None) -> Callable[[DataFrame], DataFrame]:
    return lambda df: df.withColumn(step.field.name, step_column(df, step, sums, fill, draw))
