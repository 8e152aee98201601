"""Layouts: what a scenario costs by several aims, its gradient, and the descent of all scenarios of a fleet at once.

A scenario is a row of raw quantities side by side, as ``rules`` has them. The objective is a sum of a cost, the squared miss
of a ratio (daylight), weighted areas (energy), and soft penalties for pairs (lhs, rhs) of which the first should stay below
the second by a number of deviations.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from belvane.operators import rules as by_rule
from belvane.operators.rules import Rules


class Objective(NamedTuple):
    cost: str
    area: str
    floor: str
    energy: dict[str, float] = {}
    below: tuple[tuple[str, str], ...] = ()
    target: float = 0.10
    w_cost: float = 1e-4
    w_daylight: float = 400.0
    w_energy: float = 0.02
    w_penalty: float = 200.0
    deviations: float = 2.0
    softness: float = 0.01


def _partials(rules: Rules, q: str, raws: list[str]) -> dict[str, Column]:
    """The derivatives of a quantity by raw ones, in a row of ``rules.with_gradient``."""
    if q not in rules:
        return {r: F.lit(1.0 if r == q else 0.0) for r in raws}
    own = by_rule.raws_of(rules, q)
    return {r: F.col(f"d_{q}_{r}") if r in own else F.lit(0.0) for r in raws}


def evaluated(wide: DataFrame, rules: Rules, aim: Objective, params: list[str]) -> DataFrame:
    """``wide`` with the derived quantities, the terms cost, daylight, energy and penalty (weighted), ``objective``, their sum,
    and g_param, its derivative by each of ``params``, deviations held fixed. Columns alone; nothing is shuffled."""
    raws = sorted({*params, *by_rule.free(rules), *[q for q in (aim.cost, aim.area, aim.floor, *aim.energy, *[x for p in aim.below for x in p]) if q not in rules]})
    rows = by_rule.with_gradient(wide, rules)
    d = lambda q: _partials(rules, q, raws)
    ratio = F.col(aim.area) / F.col(aim.floor)
    miss = ratio - aim.target
    terms = {"cost": aim.w_cost * F.col(aim.cost), "daylight": aim.w_daylight * miss * miss, "energy": aim.w_energy * sum([u * F.col(q) for q, u in aim.energy.items()], F.lit(0.0))}
    grad = {p: aim.w_cost * d(aim.cost)[p] + 2 * aim.w_daylight * miss * (d(aim.area)[p] - ratio * d(aim.floor)[p]) / F.col(aim.floor) + aim.w_energy * sum([u * d(q)[p] for q, u in aim.energy.items()], F.lit(0.0)) for p in params}
    penalty = F.lit(0.0)
    for low, high in aim.below:
        a, b = d(low), d(high)
        sigma = F.sqrt(sum([F.pow((b[r] - a[r]) * F.coalesce(F.col(f"s_{r}"), F.lit(0.0)), F.lit(2)) for r in raws], F.lit(0.0)))
        z = (F.col(low) - F.col(high) + aim.deviations * sigma) / aim.softness
        penalty = penalty + aim.softness * F.when(z > 40, z).otherwise(F.log1p(F.exp(F.least(z, F.lit(40.0)))))
        share = 1 / (1 + F.exp(-F.greatest(F.least(z, F.lit(40.0)), F.lit(-40.0))))
        grad = {p: grad[p] + aim.w_penalty * share * (a[p] - b[p]) for p in params}
    terms["penalty"] = aim.w_penalty * penalty
    rows = rows.withColumns({f"term_{k}": v for k, v in terms.items()})
    return rows.withColumns({"objective": sum([F.col(f"term_{k}") for k in terms], F.lit(0.0)), **{f"g_{p}": v for p, v in grad.items()}})


class _Values:
    """The same for arrays of scenarios, inside a task: quantities and their derivatives by raw ones."""

    def __init__(self, raw: dict[str, np.ndarray], rules: Rules):
        n = len(next(iter(raw.values())))
        self.mean, self.by = dict(raw), {q: {q: np.ones(n)} for q in raw}
        for level in by_rule.ordered(rules):
            for out in level:
                self.mean[out], self.by[out] = np.zeros(n), {}
                for c, factors in rules[out]:
                    self.mean[out] = self.mean[out] + c * np.prod([self.mean[f] for f in factors], axis=0) * np.ones(n)
                    for k, f in enumerate(factors):
                        rest = c * np.prod([self.mean[g] for i, g in enumerate(factors) if i != k], axis=0) * np.ones(n)
                        for r, v in self.by[f].items():
                            self.by[out][r] = self.by[out].get(r, 0.0) + rest * v

    def objective(self, aim: Objective, params: list[str], sigma: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        m, d = self.mean, lambda q, p: self.by[q].get(p, 0.0)
        ratio = m[aim.area] / m[aim.floor]
        miss = ratio - aim.target
        value = aim.w_cost * m[aim.cost] + aim.w_daylight * miss * miss + aim.w_energy * sum(u * m[q] for q, u in aim.energy.items())
        grad = {p: aim.w_cost * d(aim.cost, p) + 2 * aim.w_daylight * miss * (d(aim.area, p) - ratio * d(aim.floor, p)) / m[aim.floor] + aim.w_energy * sum(u * d(q, p) for q, u in aim.energy.items()) for p in params}
        for low, high in aim.below:
            spread = np.sqrt(sum((((d(high, r) - d(low, r)) * s) ** 2 for r, s in sigma.items()), np.zeros(len(value))))
            z = (m[low] - m[high] + aim.deviations * spread) / aim.softness
            value = value + aim.w_penalty * aim.softness * np.where(z > 40, z, np.log1p(np.exp(np.minimum(z, 40))))
            share = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
            grad = {p: grad[p] + aim.w_penalty * share * (d(low, p) - d(high, p)) for p in params}
        return value, np.stack([np.broadcast_to(grad[p], value.shape) for p in params], axis=1)


def _descend(batches: Iterator[pa.RecordBatch], rules: Rules, aim: Objective, params: list[str], raws: list[str], rounds: int, first: float, tol: float, tries: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        column = lambda c: b.column(c).to_numpy(zero_copy_only=False).astype(float)  # noqa: E731, B023
        raw, sigma = {r: column(r) for r in raws}, {r: np.nan_to_num(column(f"s_{r}")) for r in raws}

        def at(x: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            here = {r: raw[r][rows] for r in raws} | {p: x[:, k] for k, p in enumerate(params)}  # noqa: B023
            return _Values(here, rules).objective(aim, params, {r: s[rows] for r, s in sigma.items()})  # noqa: B023

        x = np.stack([raw[p] for p in params], axis=1)
        all_ = np.arange(len(x))
        value, grad = at(x, all_) if len(x) else (np.zeros(0), np.zeros((0, len(params))))
        begun, step, steps, done = value.copy(), np.full(len(x), first), np.zeros(len(x), dtype=np.int64), ~np.isfinite(value)
        settled = np.zeros(len(x), dtype=bool)
        for _ in range(rounds):
            size = np.linalg.norm(grad, axis=1)
            settled |= ~done & (size < tol)
            done |= settled
            open_ = np.flatnonzero(~done)
            if not len(open_):
                break
            for _ in range(tries):
                new = x[open_] - step[open_, None] * grad[open_]
                v, g = at(new, open_)
                good = v <= value[open_] - 1e-4 * step[open_] * size[open_] ** 2
                won = open_[good]
                x[won], value[won], grad[won] = new[good], v[good], g[good]
                step[won] *= 1.5
                steps[won] += 1
                open_ = open_[~good]
                step[open_] *= 0.5
                if not len(open_):
                    break
            done[open_] = True  # no step helps
            settled[open_] |= size[open_] < 1e-3
        made = [pa.array(x[:, k]) for k in range(len(params))]
        yield pa.RecordBatch.from_arrays([b.column("model"), b.column("entity"), *made, pa.array(begun), pa.array(value), pa.array(steps), pa.array(settled)], ["model", "entity", *params, "before", "after", "steps", "converged"])


def optimised(wide: DataFrame, rules: Rules, aim: Objective, params: list[str], *, rounds: int = 60, first: float = 1e-3, tol: float = 1e-6, tries: int = 25) -> DataFrame:
    """model, entity, the ``params`` where the descent ends, before and after (the objective), steps and converged, for every
    scenario of ``wide``. Each task descends its scenarios together; each has a step of its own, halved until the objective
    falls enough and half as long again after that. A scenario whose objective isn't finite stays and isn't converged.
    Nothing is shuffled."""
    raws = sorted({*params, *by_rule.free(rules), *[q for q in (aim.cost, aim.area, aim.floor, *aim.energy, *[x for p in aim.below for x in p]) if q not in rules]})
    kinds = {f.name: f.dataType.simpleString() for f in wide.schema}
    schema = f"model {kinds['model']}, entity {kinds['entity']}, " + ", ".join(f"`{p}` double" for p in params) + ", before double, after double, steps long, converged boolean"
    read = wide.select("model", "entity", *[F.col(r).cast("double").alias(r) for r in raws], *[(F.col(f"s_{r}") if f"s_{r}" in wide.columns else F.lit(0.0)).cast("double").alias(f"s_{r}") for r in raws])
    return read.mapInArrow(partial(_descend, rules=rules, aim=aim, params=params, raws=raws, rounds=rounds, first=first, tol=tol, tries=tries), schema)


def interventions(found: DataFrame, param: str, design_sigma: float = 0.005) -> DataFrame:
    """model, entity, value, design_sigma: the optimum of one quantity as changes for ``rules.with_changes``."""
    return found.select("model", "entity", F.col(param).alias("value"), F.lit(design_sigma).alias("design_sigma"))
