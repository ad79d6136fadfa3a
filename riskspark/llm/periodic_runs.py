"""Periodic runs of words: multi-scale minimizers seed them, direct lag scans cover short periods.

A run is a longest stretch of consecutive words with smallest period ``q`` and at least
``max(6, 4 q)`` words. Periods up to ``SHORT`` are found by comparing the words with themselves ``q``
places on. Longer ones are found scale by scale; a scale ``s`` covers the periods ``q`` with
``2 s - 1 <= 3 q`` and ``q <= s``. Its minimizers are the leftmost smallest hashes of ``s``-word grams
in windows of ``s`` neighbouring grams. Inside a run of such a period a gram is at least a period long,
so grams of different phase differ, and a window holds every phase: all windows choose the same phase.
A run is long enough for two windows that lie ``q`` apart, so two chosen positions with the same gram,
with none between, lie exactly ``q`` apart. These pairs are the seeds; comparing words to both sides
extends a seed to the whole run. No run is missed and none is reported that the words do not have
(words are compared by 64-bit hashes).

All texts of a chunk are laid end to end with a unique mark after each, so one set of array operations
serves many texts; larger scales keep only texts long enough for them. One text is one row in one task.

Defined results: a NULL text is empty and has no runs; words are told apart by case; repeated rows give
repeated results; a NULL id is never altered; an empty table gives none; other columns are not touched.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from fractions import Fraction
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskspark.llm.common import whole
from riskspark.llm.words import chunks, mix, word_hashes

U64 = np.uint64
LEAST_WORDS, LEAST_PERIODS = 6, 4
SHORT = 8
EXTEND_CELLS = 1 << 20
RUNS_TYPE = "array<struct<start:bigint,length:bigint,period:bigint>>"
_LEFT, _RIGHT, _MARK = U64(0xD6E8FEB86659FD93), U64(0xA0761D6478BD642F), U64(0xE7037ED1A0B428DB)


@lru_cache(maxsize=4096)
def _prime_factors(n: int) -> tuple[int, ...]:
    found, f = [], 2
    while f * f <= n:
        if n % f == 0:
            found.append(f)
            while n % f == 0:
                n //= f
        f += 1
    return (*found, n) if n > 1 else tuple(found)


def _joined(a: np.ndarray, step: int) -> np.ndarray:
    """Hash of the gram at each place and the one ``step`` places on; the end wraps onto the first words."""
    return mix(a * _LEFT + np.roll(a, -step) * _RIGHT)


def _minimizers(grams: np.ndarray, window: int) -> np.ndarray:
    """Sorted places that are the leftmost smallest gram of some window of places."""
    value, place, width = grams, np.arange(len(grams)), 1
    while width < window:
        step = min(width, window - width)
        other = np.roll(value, -step)
        less = other < value
        place = np.where(less, np.roll(place, -step), place)
        value = np.where(less, other, value)
        width += step
    chosen = np.zeros(len(grams), bool)
    chosen[place] = True
    return np.flatnonzero(chosen)


def _matching(words: np.ndarray, x: np.ndarray, lag: np.ndarray, direction: int) -> np.ndarray:
    """How many places from ``x`` on (or back) hold the word found ``lag`` places later."""
    done = np.zeros(len(x), np.int64)
    active, step, n = np.arange(len(x)), 16, len(words)
    while len(active):
        at = x[active, None] + direction * (done[active, None] + np.arange(step))
        other = at + lag[active, None]
        outside = (at < 0) | (other >= n)
        unequal = outside | (words[np.where(outside, 0, at)] != words[np.where(outside, 0, other)])
        ends = unequal.any(axis=1)
        done[active] += np.where(ends, unequal.argmax(axis=1), step)
        active = active[~ends]
        step = max(1, min(step * 2, EXTEND_CELLS // max(1, len(active))))
    return done


def _seeded(words: np.ndarray, grams: np.ndarray, low: int, scale: int) -> Iterator[tuple[int, int, int]]:
    """Stretches (start, end, lag) around pairs of equal neighbouring minimizers with such a lag."""
    places = _minimizers(grams, scale)
    keys = grams[places]
    order = np.argsort(keys, kind="stable")
    places, keys = places[order], keys[order]
    lag = np.diff(places)
    fits = (keys[1:] == keys[:-1]) & (lag >= low) & (lag <= scale)
    again = np.zeros(len(lag), bool)  # the pair before it lies in the same stretch
    again[1:] = fits[1:] & fits[:-1] & (lag[1:] == lag[:-1])
    seeds = np.flatnonzero(fits & ~again)
    x, lag = places[seeds], lag[seeds]
    if len(x):
        start = x - _matching(words, x - 1, lag, -1)
        end = x + lag + _matching(words, x, lag, 1)
        yield from zip(start.tolist(), end.tolist(), lag.tolist(), strict=True)


def _lagged(words: np.ndarray, lag: int) -> Iterator[tuple[int, int, int]]:
    """Stretches whose words repeat ``lag`` places on, long enough for a run."""
    same = np.flatnonzero(words[lag:] == words[:-lag])
    if not len(same):
        return
    breaks = np.flatnonzero(np.diff(same) != 1)
    first = same[np.concatenate([[0], breaks + 1])]
    last = same[np.concatenate([breaks, [len(same) - 1]])]
    long = last - first + 1 + lag >= max(LEAST_WORDS, LEAST_PERIODS * lag)
    for start, end in zip(first[long].tolist(), last[long].tolist(), strict=True):
        yield start, end + lag + 1, lag


def _is_run(words: np.ndarray, start: int, end: int, lag: int) -> bool:
    """Long enough, and no divisor of the lag is a period too (a smaller period would divide it)."""
    if end - start < max(LEAST_WORDS, LEAST_PERIODS * lag):
        return False
    return not any(
        np.array_equal(words[start : end - lag // f], words[start + lag // f : end]) for f in _prime_factors(lag)
    )


def find_runs(texts: list[np.ndarray]) -> list[list[tuple[int, int, int]]]:
    """Runs (start, length, period) of each array of word hashes, by start, then period."""
    lengths = np.array([len(t) for t in texts], np.int64)
    found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    kept = lengths >= LEAST_WORDS
    marks = mix(np.arange(1, len(texts) + 1, dtype=U64) * _MARK)
    numbers = np.flatnonzero(kept)
    if not len(numbers):
        return found
    words = np.concatenate([part for k in numbers for part in (texts[k], marks[k : k + 1])])
    sizes = lengths[numbers] + 1
    begins = np.cumsum(sizes) - sizes
    stretches: set[tuple[int, int, int]] = set()
    longest = int(lengths.max())
    for lag in range(1, min(SHORT, longest // LEAST_PERIODS) + 1):
        stretches.update(s for s in _lagged(words, lag) if _is_run(words, *s))
    # places of the texts still long enough, their words, and hashes of grams of a power of two of words
    places, near, grams, width = np.arange(len(words)), words, words, 1
    low = SHORT + 1
    while low * LEAST_PERIODS <= longest:
        scale = (3 * low + 1) // 2
        long = np.repeat(sizes > LEAST_PERIODS * low, sizes)[places]
        if not long.all():
            places, near, grams = places[long], near[long], grams[long]
        while width * 2 <= scale:
            grams, width = _joined(grams, width), width * 2
        whole_grams = grams if width == scale else _joined(grams, scale - width)
        for start, end, lag in _seeded(near, whole_grams, low, scale):
            if _is_run(near, start, end, lag):
                at = int(places[start])
                stretches.add((at, at + end - start, lag))
        low = scale + 1
    owner = np.searchsorted(begins, [s[0] for s in stretches], side="right") - 1 if stretches else []
    for k, (start, end, lag) in zip(owner, stretches, strict=True):
        found[numbers[k]].append((start - int(begins[k]), end - start, lag))
    for runs in found:
        runs.sort(key=lambda r: (r[0], r[2]))
    return found


def dropped_words(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Whether each of ``n`` words lies in a run after that run's first period."""
    edge = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        edge[start + period] += 1
        edge[start + length] -= 1
    return np.cumsum(edge[:n]) > 0


def repeated_tail(n: int, seed: int) -> np.ndarray:
    """Word numbers of a text of ``n`` words whose end is replaced by repeats, as the seed says."""
    at = seed % n
    period = 1 + (n - at) // (3 + seed % 8)
    numbers = np.arange(n)
    numbers[at:] = at + (numbers[at:] - at) % period
    return numbers


def _hex(body: bytes) -> str:
    return hashlib.sha256(body).hexdigest()


def _measured(texts: pa.Array, seeds: list[int | None]) -> tuple[list, list[str], list[str]]:
    hashes, first = word_hashes(texts, lower=False)
    orders = []
    for k, seed in enumerate(seeds):
        n = int(first[k + 1] - first[k])
        orders.append(repeated_tail(n, seed) if n and seed is not None else None)
    parts = [hashes[first[k] : first[k + 1]] for k in range(len(texts))]
    parts = [part if order is None else part[order] for part, order in zip(parts, orders, strict=True)]
    found = find_runs(parts)
    lists, collapsed = [], []
    for text, order, runs, part in zip(texts, orders, found, parts, strict=True):
        lists.append(_hex("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()))
        body = (text.as_py() or b"").split()  # bytes split at the white space that ends words
        if order is not None:
            body = [body[i] for i in order]
        if runs:
            gone = dropped_words(len(part), runs)
            body = [word for word, drop in zip(body, gone.tolist(), strict=True) if not drop]
        collapsed.append(_hex(b" ".join(body)))
    return found, lists, collapsed


RESULT = f"struct<runs:{RUNS_TYPE},runs_sha256:string,collapsed_sha256:string>"


def _runs_of(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    run_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
    for texts, seeds in batches:
        texts = texts.cast(pa.large_binary())
        runs, lists, collapsed = [], [], []
        for a, b in chunks(texts):
            found, digests, bodies = _measured(texts.slice(a, b - a), seeds.slice(a, b - a).to_pylist())
            runs += [[dict(zip(("start", "length", "period"), r, strict=True)) for r in rs] for rs in found]
            lists += digests
            collapsed += bodies
        columns = [pa.array(runs, run_type), pa.array(lists, pa.string()), pa.array(collapsed, pa.string())]
        yield pa.StructArray.from_arrays(columns, ["runs", "runs_sha256", "collapsed_sha256"])


def best_run(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run of greatest exact exponent; of equals the first start, then the smallest period."""
    return min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)


def with_runs(docs: DataFrame, text: str = "text", seed=None, name: str = "found") -> DataFrame:
    """``docs`` with column ``name``: all runs, the digest of their list and that of the collapsed text.

    ``seed`` (a column of longs) asks for texts whose end is first replaced by repeats; NULL leaves a
    text as it is.
    """
    seeds = F.lit(None).cast("bigint") if seed is None else seed.cast("bigint")
    return docs.withColumn(name, F.arrow_udf(_runs_of, RESULT)(whole(text).cast("binary"), seeds))


def strongest(runs):
    """Column expression of the run with the greatest length / period (no run: NULL), compared exactly."""

    def better(a, b):
        left = a["length"].cast("decimal(19,0)") * b["period"]
        right = b["length"].cast("decimal(19,0)") * a["period"]
        return left > right

    # runs come by start, then period, so the first of equals stays
    return F.aggregate(
        runs,
        F.get(runs, F.lit(0)),
        lambda best, run: F.when(better(run, best), run).otherwise(best),
    )
