"""Seeded faults for crash tests: independent streams of one seed, trials in parts per thousand, and what becomes of an unsynced write."""

from __future__ import annotations

import random
from enum import Enum


class Fate(Enum):
    DURABLE = "durable"
    LOST = "lost"
    TORN = "torn"


def stream(seed: int, name: str) -> random.Random:
    """The draws of one purpose: streams of one seed do not disturb each other, whatever each of them draws."""
    return random.Random(f"{seed}/{name}")


def happens(draws: random.Random, per_thousand: int) -> bool:
    """One trial. A fault that is switched off draws nothing, so the rest of its stream stays as it was."""
    return per_thousand > 0 and draws.randrange(1000) < per_thousand


def fate(draws: random.Random, lost: int, torn: int) -> Fate:
    """What a crash leaves of a write, from one draw in every case: shares per thousand are lost, then torn, the others durable."""
    roll = draws.randrange(1000)
    return Fate.LOST if roll < lost else Fate.TORN if roll < lost + torn else Fate.DURABLE
