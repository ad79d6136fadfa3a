"""Small tables with every odd case, and plain re-statements of the contracts."""

from __future__ import annotations

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
VOCABULARY = [f"{a}{b}{c}" for a in ("ka", "lo", "mi", "né", "ru") for b in ("ta", "vo", "si", "pu") for c in ("", "n", "s", "ß")]
# columns whose names the operators use themselves
CLASHING = "score string, kept int, keep_id string, rep int, node string, n long, rate string, copies string, length int, held boolean, margin int, doc int"


def words(text: str | None) -> list[str]:
    return WORD.findall((text or "").translate(_LOWER))


def sentence(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(VOCABULARY) for _ in range(n))


def edited(text: str, seed: int, changes: int) -> str:
    rng, parts = random.Random(seed), text.split(" ")
    for _ in range(changes):
        parts[rng.randrange(len(parts))] = f"edit{rng.randrange(10**6)}"
    return " ".join(parts)


def odd_texts() -> list[tuple[int | None, str | None]]:
    """(id, text): NULLs, empty, blank, repeated, very long, ties, control and non-ASCII characters."""
    base = sentence(1, 120)
    rows: list[tuple[int | None, str | None]] = [
        (1, base), (2, base), (3, base.upper()), (4, None), (5, ""), (6, " \t\n"), (7, "one"), (8, "One two"), (8, "One two"),
        (9, sentence(2, 30000)), (10, "x" * 200_000), (None, "no id here at all"), (None, None), (11, "é" * 50 + "\x00\x1f"),
        (12, base + " "), (13, "one two three"), (14, "one two three four five"),
    ]
    rows += [(100 + i, edited(base, i, i % 30)) for i in range(60)]
    rows += [(200 + i, sentence(1000 + i, 40 + i)) for i in range(40)]
    return rows


def docs(spark, rows=None):
    """documents with extra columns that clash with names used inside the operators."""
    rows = odd_texts() if rows is None else rows
    wide = [(i, t, None, "hot" if k % 3 else None, None, *([None] * 12)) for k, (i, t) in enumerate(rows)]
    return spark.createDataFrame(wide, f"doc_id long, text string, lang string, source string, n_chars long, {CLASHING}")


class Union:
    """Smallest reachable element, by plain union-find."""

    def __init__(self):
        self.parent: dict[int, int] = {}

    def find(self, x: int) -> int:
        self.parent.setdefault(x, x)
        while self.parent[x] != x:
            x = self.parent[x]
        return x

    def join(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        self.parent[max(a, b)] = min(a, b)
