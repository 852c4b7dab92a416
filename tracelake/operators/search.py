"""Search over a simulator: look-ahead rollouts, commit, rewind. The simulator is a plug-in.

A simulator gives ``reset(state)``, ``step(action) -> ram``, ``save()`` and ``load(state)``; ``Corridor`` is a small deterministic one for tests. One search is
one task (``searches`` runs many seeds in parallel through Arrow groups); the loop inside is serial by nature."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Simulator(Protocol):
    actions: int

    def reset(self, seed: int) -> None: ...
    def step(self, action: int) -> tuple[float, bool, bool]: ...  # reward, dead, won
    def save(self) -> tuple: ...
    def load(self, state: tuple) -> None: ...


class Corridor:
    """Walk right past traps to the goal: action 0 waits, 1 walks, 2 jumps over the next cell; stepping on a trap kills."""

    actions = 3

    def __init__(self, length: int = 40):
        self.length = length

    def reset(self, seed: int) -> None:
        rng = np.random.default_rng(seed)
        free = np.ones(self.length, dtype=bool)
        at = 3
        while at < self.length - 2:
            free[at] = False
            at += int(rng.integers(2, 6))
        self.free, self.x = free, 0

    def step(self, action: int) -> tuple[float, bool, bool]:
        move = (0, 1, 2)[action]
        self.x = min(self.length - 1, self.x + move)
        dead = not self.free[self.x]
        return float(move), dead, not dead and self.x == self.length - 1

    def save(self) -> tuple:
        return self.x, self.free

    def load(self, state: tuple) -> None:
        self.x, self.free = state


@dataclass
class Config:
    rollouts: int = 16
    length: int = 24
    settle: int = 8
    max_rewind: int = 15
    budget: int = 20_000  # simulated steps


@dataclass
class Search:
    sim: Simulator
    config: Config
    seed: int
    prior: np.ndarray | None = None  # row-stochastic, by previous action
    history: list[int] = field(default_factory=list)

    def rollout(self, rng: np.random.Generator, last: int | None, length: int) -> tuple[list[int], float, bool, bool]:
        """Actions, reward, died, won. A rollout stops at death before that step is scored."""
        seq, total = [], 0.0
        for _ in range(length):
            p = None if self.prior is None or last is None else self.prior[last]
            a = int(rng.choice(self.sim.actions, p=p))
            reward, dead, won = self.sim.step(a)
            seq.append(a)
            last = a
            if dead:
                return seq, total, True, False
            total += reward
            if won:
                return seq, total, False, True
        return seq, total, False, False

    def run(self) -> dict:
        c, rng = self.config, np.random.default_rng(self.seed)
        self.sim.reset(self.seed)
        states, steps, rollouts = [self.sim.save()], 0, c.rollouts
        while steps < c.budget:
            base, best = states[-1], None
            died = 0
            for _ in range(rollouts):
                self.sim.load(base)
                r = self.rollout(rng, self.history[-1] if self.history else None, c.length)
                steps += len(r[0])
                died += r[2]
                if best is None or r[1] > best[1]:  # the first of equals wins
                    best = r
                if r[3]:
                    best = r
                    break
            seq, _, dead, won = best
            if dead and self.history:  # the best one died: back off, look with twice as many rollouts
                n = int(rng.integers(1, min(c.max_rewind, len(self.history)) + 1))
                del self.history[-n:], states[-n:]
                rollouts = min(rollouts * 2, 16 * c.rollouts)
                continue
            cap = len(seq) if won else max(1, len(seq) - c.settle)
            n = cap if won else int(rng.integers((cap + 1) // 2, cap + 1)) if cap > 1 else 1
            self.sim.load(base)
            for a in seq[:n]:
                _, dead, won = self.sim.step(a)
                if dead:
                    break
                self.history.append(a)
                states.append(self.sim.save())
                if won:
                    return {"win": True, "steps": steps, "actions": list(self.history)}
            if died < rollouts / 2:
                rollouts = c.rollouts
        return {"win": False, "steps": steps, "actions": list(self.history)}


def searches(spark: SparkSession, seeds: int, make: Callable[[], Simulator] = Corridor, config: Config | None = None) -> DataFrame:
    """seed, win, steps, actions, replay_valid of one search per seed; a win counts as valid if its actions, replayed, win again."""
    config = config or Config()

    def run(part: pd.DataFrame) -> pd.DataFrame:
        out = []
        for seed in part["id"].tolist():
            got = Search(make(), config, int(seed)).run()
            sim, won = make(), False
            sim.reset(int(seed))
            for a in got["actions"]:
                _, dead, won = sim.step(a)
                if dead:
                    break
            out.append((seed, got["win"], got["steps"], got["actions"], bool(won)))
        return pd.DataFrame(out, columns=["seed", "win", "steps", "actions", "replay_valid"])

    return spark.range(seeds).groupBy(F.col("id")).applyInPandas(run, "seed bigint, win boolean, steps bigint, actions array<bigint>, replay_valid boolean")


def capture_starts(steps: DataFrame, key: list[str], step: str, hp: str, left: int = 8, seed: int = 0) -> DataFrame:
    """One start per sequence, by hash among the steps at or after the first peak of ``hp`` with hp > 0 and at least ``left`` steps to go."""
    from pyspark.sql import Window

    w = Window.partitionBy(*key)
    t = steps.withColumns({"_peak": F.max(hp).over(w), "_end": F.max(step).over(w)})
    t = t.withColumn("_from", F.min(F.when(F.col(hp) == F.col("_peak"), F.col(step))).over(w))
    ok = t.where((F.col(hp) > 0) & (F.col(step) >= F.col("_from")) & (F.col("_end") - F.col(step) >= left))
    return ok.groupBy(*key).agg(F.min_by(step, F.xxhash64(F.lit(seed), *key, step)).alias("start_step"))
