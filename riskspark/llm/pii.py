"""Personal data: fixed base patterns plus a semi-Markov conditional random field.

Base spans (e-mail, IP, card, phone) follow exact rules. Around every digit, ``@``, bracketed ``at`` and
word ``at`` before a host with a dot (a point or the word, in any case) a region is cut that holds every
segment with that trigger, and tokenised; candidate segments of at most ``MAX_TOKENS`` tokens get
whole-span features (shape, digit count, Luhn, separators, word before), and dynamic programming over
bounded segments chooses the jointly best boundaries and types. The chosen segments that touch no base span are added.

Training: narrower regions, none of which cuts a base span or holds a spoken form (which no base pattern
can label), of a bounded sample of documents (``sample_docs`` documents chosen by a hash of the
id, ``sample_regions`` regions), labelled with their base spans, plus rewritten copies (``name at host
dot com``, numbers without ``+``, cards in groups of four) that keep the label. The weights maximise
the conditional likelihood by forward-backward sums.

Defined results: NULL text is empty and has no spans; offsets are code points, end exclusive; every
input row gives one output row. Regions cover every trigger of the whole text, however long; the work
is linear in the text, since segments are bounded.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskspark.llm.common import whole

KINDS = ("email", "ip", "card", "phone")
# fixed values: the base patterns
_HOST = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]+){2}\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL_CHARS = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")

GAP = 24
MAX_TOKENS = 20
MAX_CHARS = 80
REACH = MAX_CHARS + GAP  # a segment and the text before it that features look at
# every e-mail segment holds a sign or the word at; without a dot in the host the word is no trigger
_SPOKEN = re.compile(rf"[(\[{{]at[)\]}}]|\bat\b(?=[)\]}}]?\s?[^\s.]{{0,{MAX_CHARS}}}(?:\.\S|\.?\s?[(\[{{]?dot\b))", re.I)
_TRIGGER = re.compile(rf"[0-9@]|{_SPOKEN.pattern}", re.I)
_AT = re.compile(r"\s?[(\[{]?(?:@|\bat\b)[)\]}]?\s?", re.I)
_DOT = re.compile(r"\.|[\s(\[{]dot[\s)\]}]", re.I)
_TAIL = re.compile(r"(?:\.|dot[\s)\]}]\s?)[A-Za-z]{2,6}$", re.I)
_STRAY = re.compile(r"\s(?![(\[{]?dot\b)(?<!\bdot\s)(?<!\bdot[)\]}]\s)", re.I)  # a blank not beside dot
_TOKEN = re.compile(r"[0-9]+|[A-Za-z]+|[^\W\d_]+|\s+|.", re.S)
_CUES = {
    "email": ("mail", "email", "contact", "courriel", "correo"),
    "ip": ("ip", "host", "server", "address", "adresse"),
    "card": ("card", "visa", "mastercard", "carte", "karte", "tarjeta"),
    "phone": ("tel", "phone", "call", "fax", "mobile", "telefon", "telephone", "telefono"),
}


def luhn(digits: str) -> bool:
    total = 0
    for i, char in enumerate(reversed(digits)):
        value = ord(char) - 48
        if i % 2:
            value = value * 2 - 9 * (value > 4)
        total += value
    return total % 10 == 0


def _digits(text: str) -> str:
    return re.sub(r"[^0-9]", "", text)


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches found from each ``@``: linear in the text, also in long runs without one."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        host = _HOST.match(text, at + 1) if start < at else None
        if host:
            yield start, host.end()
            done = host.end()
        else:
            done = at + 1
        at = text.find("@", done)


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """Spans per kind by the fixed rules; matches that fail their check are dropped without a retry."""
    found = {kind: [] for kind in KINDS}
    found["email"] = list(_emails(text))
    for match in _IP.finditer(text):
        parts = [part.lstrip("0") or "0" for part in match.group().split(".")]
        if all(len(part) <= 3 and int(part) <= 255 for part in parts):
            found["ip"].append(match.span())
    for match in _CARD.finditer(text):
        if match.end() - match.start() >= 13:
            digits = _digits(match.group())
            if 13 <= len(digits) <= 19 and luhn(digits):
                found["card"].append(match.span())
    for match in _PHONE.finditer(text):
        if 9 <= len(_digits(match.group())) <= 15:
            found["phone"].append(match.span())
    return found


def regions(text: str, apart: int = 2 * REACH) -> Iterator[tuple[int, int]]:
    """Stretches of triggers at most ``apart`` characters from the next, widened by REACH but not beyond
    the middle between two stretches; with the default, no widening is cut short."""
    stretches: list[list[int]] = []
    for match in _TRIGGER.finditer(text):
        if stretches and match.start() - stretches[-1][1] <= apart:
            stretches[-1][1] = match.end()
        else:
            stretches.append(list(match.span()))
    for i, (start, end) in enumerate(stretches):
        low = (stretches[i - 1][1] + start) // 2 if i else 0
        high = (end + stretches[i + 1][0]) // 2 if i + 1 < len(stretches) else len(text)
        yield max(low, start - REACH), min(high, end + REACH)


class Region:
    """Tokens of one region and its candidate segments with their features."""

    def __init__(self, text: str):
        self.tokens = [m.span() for m in _TOKEN.finditer(text)]
        self.text = text
        # candidates by their last token: (first token, kind number, feature names)
        self.ending: list[list[tuple[int, int, tuple[str, ...]]]] = [[] for _ in self.tokens]
        digits = [0]
        ats = [0]
        blanks = [0]
        for start, end in self.tokens:
            piece = text[start:end]
            digits.append(digits[-1] + (end - start if piece[0] in "0123456789" else 0))
            ats.append(ats[-1] + (piece == "@" or piece.lower() == "at"))
            blanks.append(blanks[-1] + (" " in piece))
        if digits[-1] < 4 and not ats[-1]:
            return
        signs = [k for k in range(len(self.tokens)) if ats[k + 1] > ats[k]]
        hosts = [self._host_end(k) for k in signs]
        for first, (start, _) in enumerate(self.tokens):
            head = text[start]
            if head.isspace() or not (head in "+(" or head.isalnum()):
                continue
            sign = signs[ats[first]] if ats[first] < len(signs) else -1
            named = first < sign < first + MAX_TOKENS and head not in "+(" and blanks[sign] - blanks[first] <= 1
            host = hosts[ats[first]] if named else -1
            numeric = head in "+(" or head.isdigit()
            stop = min(len(self.tokens), first + MAX_TOKENS)
            for last in range(first, stop if numeric else min(stop, host + 1)):
                end = self.tokens[last][1]
                if end - start > MAX_CHARS:
                    break
                if not text[end - 1].isalnum():
                    continue
                n_digits, n_ats = digits[last + 1] - digits[first], ats[last + 1] - ats[first]
                if n_ats == 1 and last - first >= 4 and last <= host:
                    self._add(first, last, 0, n_digits)
                if n_ats == 0 and n_digits >= 4 and numeric and text[end - 1].isdigit():
                    if n_digits <= 12 and last - first == 6:
                        self._add(first, last, 1, n_digits)
                    if 12 <= n_digits <= 20 and head.isdigit():
                        self._add(first, last, 2, n_digits)
                    if 7 <= n_digits <= 15:
                        self._add(first, last, 3, n_digits)

    def _host_end(self, sign: int) -> int:
        """The last token that may belong to the host after a sign: blanks stand beside the word dot."""
        words = [self.text[a:b].lower() for a, b in self.tokens[sign + 1 : sign + 1 + MAX_TOKENS]]
        for i, word in enumerate(words):
            bracket = i == 1 and words[0] in ")]}"
            if word.isspace() and i and not bracket and "dot" not in words[max(0, i - 2) : i + 3]:
                return sign + i
        return sign + len(words)

    def _add(self, first: int, last: int, kind: int, n_digits: int) -> None:
        features = self._features(first, last, kind, n_digits)
        if features:
            self.ending[last].append((first, kind, features))

    def _features(self, first: int, last: int, kind: int, n_digits: int) -> tuple[str, ...]:
        text, name = self.text, KINDS[kind]
        start, end = self.tokens[first][0], self.tokens[last][1]
        span = text[start:end]
        shape = re.sub(r"(.)\1+", r"\1", re.sub(r"[0-9]+", "9", re.sub(r"[^\W\d_]+", "a", span)))
        if kind == 0:
            at = _AT.search(span)
            host = span[at.end() :] if at else ""
            if not at or not at.start() or not host or _STRAY.search(host) or " " in span[: at.start()]:
                return ()
            dots = len(_DOT.findall(host))
            features = [f"dots={min(dots, 3)}", f"sign={'@' in span}", f"tail={bool(_TAIL.search(host))}"]
        elif kind == 1:
            parts = span.split(".")
            if len(parts) != 4 or not all(p.isdigit() for p in parts):
                return ()
            features = [f"octets={all(len(p) <= 3 and int(p) <= 255 for p in parts)}", f"long={n_digits}"]
        else:
            if re.search(r"[^0-9 ().+\-]|[ ().-]{3}", span):
                return ()
            others = "".join(sorted(set(re.sub(r"[0-9]", "", span))))
            features = [f"digits={n_digits}", f"marks={others}", f"plus={span[0] == '+'}"]
            if kind == 2:
                groups = [len(g) for g in re.findall(r"[0-9]+", span)]
                even = len(groups) == 1 or set(groups[:-1]) == {4}
                features += [f"luhn={luhn(_digits(span))}", f"even={even}", f"lead={span[0]}"]
            else:
                features += [f"shape={shape[:12]}", f"grouped={bool(re.search(r'[0-9]{3}[ .-][0-9]{4}$', span))}"]
        before = text[max(0, start - GAP) : start]
        word = re.findall(r"[^\W\d_]+", before.lower())
        cue = bool(word) and word[-1] in _CUES[name]
        left = "edge" if not before else "space" if before[-1].isspace() else "joint" if before[-1].isalnum() else before[-1]
        after = text[end : end + 1]
        right = "edge" if not after else "space" if after.isspace() else "joint" if after.isalnum() else after
        more = text[end + 1 : end + 2].isalnum() and right not in ("space", "edge")
        features += ["bias", f"cue={cue}", f"left={left}", f"right={right}", f"more={more}"]
        return tuple(f"{name}:{f}" for f in features)


def viterbi(region: Region, weights: dict[str, float]) -> list[tuple[int, int, int]]:
    """Best segmentation as (start, end, kind); a token outside any segment scores 0."""
    best = [0.0] * (len(region.tokens) + 1)
    step: list[tuple | None] = [None] * (len(region.tokens) + 1)
    for last, candidates in enumerate(region.ending):
        value, chosen = best[last], None
        for first, kind, features in candidates:
            total = best[first] + sum(weights.get(f, 0.0) for f in features)
            if total > value:
                value, chosen = total, (first, kind)
        best[last + 1], step[last + 1] = value, chosen
    found, at = [], len(region.tokens)
    while at > 0:
        if step[at] is None:
            at -= 1
        else:
            first, kind = step[at]
            found.append((region.tokens[first][0], region.tokens[at - 1][1], kind))
            at = first
    return found[::-1]


def _expectations(region: Region, score: dict) -> tuple[float, dict]:
    """Log partition sum and each candidate's marginal probability."""
    n = len(region.tokens)
    forward, backward = np.full(n + 1, -np.inf), np.full(n + 1, -np.inf)
    forward[0] = backward[n] = 0.0
    for last in range(n):
        terms = [forward[last]] + [forward[c[0]] + score[last, i] for i, c in enumerate(region.ending[last])]
        forward[last + 1] = np.logaddexp.reduce(terms)
    for last in range(n - 1, -1, -1):
        backward[last] = np.logaddexp(backward[last], backward[last + 1])
        for i, (first, _, _) in enumerate(region.ending[last]):
            backward[first] = np.logaddexp(backward[first], score[last, i] + backward[last + 1])
    total = forward[n]
    return total, {k: np.exp(forward[region.ending[k[0]][k[1]][0]] + s + backward[k[0] + 1] - total) for k, s in score.items()}


def rewritten(text: str, spans: dict[str, list[tuple[int, int]]]) -> tuple[str, list[tuple[int, int, int]]] | None:
    """The region with its first span in a looser form, and the label of that form."""
    for kind, name in enumerate(KINDS):
        for start, end in spans[name][:1]:
            span = text[start:end]
            if name == "email":
                new = span.replace("@", " at ").replace(".", "\0", span.partition("@")[0].count(".")).replace(".", " dot ").replace("\0", ".")
            elif name == "card" and " " not in span and "-" not in span:
                new = " ".join(span[i : i + 4] for i in range(0, len(span), 4))
            elif name == "phone":
                new = "tel " + re.sub(r"^\+[0-9]+ ?", "", span)
                return text[:start] + new + text[end:], [(start + 4, start + len(new), kind)]
            else:
                continue
            return text[:start] + new + text[end:], [(start, start + len(new), kind)]
    return None


def train(samples: list[str], epochs: int = 12, rate: float = 0.5, ridge: float = 1e-3) -> dict[str, float]:
    """Weights that maximise the likelihood of the labelled regions (adaptive gradient steps)."""
    examples = []
    for text in samples:
        spans = base_spans(text)
        gold = [(s, e, k) for k, name in enumerate(KINDS) for s, e in spans[name]]
        clash = any(a[1] > b[0] for a, b in pairwise(sorted(gold)))
        if not clash:
            examples.append((Region(text), gold))
        looser = rewritten(text, spans)
        if looser and len(gold) == 1:
            examples.append((Region(looser[0]), looser[1]))
    weights: dict[str, float] = {}
    squares: dict[str, float] = {}
    for _ in range(epochs):
        for region, gold in examples:
            ends = {region.tokens[last][1]: last for last in range(len(region.tokens))}
            score = {
                (last, i): sum(weights.get(f, 0.0) for f in c[2])
                for last, cs in enumerate(region.ending)
                for i, c in enumerate(cs)
            }
            if not score:
                continue
            _, share = _expectations(region, score)
            true = set()
            for start, end, kind in gold:
                last = ends.get(end)
                for i, c in enumerate(region.ending[last] if last is not None else ()):
                    if region.tokens[c[0]][0] == start and c[1] == kind:
                        true.add((last, i))
            step: dict[str, float] = {}
            for key, p in share.items():
                delta = (key in true) - p
                if abs(delta) > 1e-6:
                    for f in region.ending[key[0]][key[1]][2]:
                        step[f] = step.get(f, 0.0) + delta
            for f, g in step.items():
                g -= ridge * weights.get(f, 0.0)
                squares[f] = squares.get(f, 1e-2) + g * g
                weights[f] = weights.get(f, 0.0) + rate * g / squares[f] ** 0.5
    return weights


def fit(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", sample_docs: int = 6000, sample_regions: int = 500
) -> dict[str, float]:
    """Train on a bounded sample: at most ``sample_regions`` regions reach the driver."""
    order = F.xxhash64("_pii_id", F.lit("sample"))
    chosen = docs.select(F.col(doc_id).alias("_pii_id")).distinct().orderBy(order, "_pii_id").limit(sample_docs)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = []
            for body in batch["_pii_text"]:
                spans = [x for each in base_spans(body).values() for x in each] if _TRIGGER.search(body) else []
                edges = sorted(spans)
                starts = [x for x, _ in edges]
                tops = np.maximum.accumulate([y for _, y in edges]) if edges else []
                for a, b in regions(body, 2 * GAP):
                    # per border: the spans that begin before it must end before it
                    before = [bisect_left(starts, x) - 1 for x in (a, b)]
                    inside = all(i < 0 or tops[i] <= x for i, x in zip(before, (a, b), strict=True))
                    if inside and b - a <= 400 + 2 * MAX_CHARS and not _SPOKEN.search(body, a, b):
                        found.append(body[a:b])
            if found:
                yield pd.DataFrame({"region": found})

    texts = docs.select(F.col(doc_id).alias("_pii_id"), whole(text).alias("_pii_text"))
    found = texts.join(F.broadcast(chosen), "_pii_id").select("_pii_text").mapInPandas(cut, "region string")
    rows = found.distinct().orderBy(F.xxhash64("region"), "region").limit(sample_regions).collect()
    return train([r["region"] for r in rows])


def spans_of(text: str, weights: dict[str, float]) -> tuple[list, list]:
    """(base spans, all spans), each as (kind number, start, end) by kind, then start."""
    base = base_spans(text)
    fixed = [(k, s, e) for k, name in enumerate(KINDS) for s, e in base[name]]
    taken = sorted((s, e) for _, s, e in fixed)
    starts, tops = [s for s, _ in taken], np.maximum.accumulate([e for _, e in taken]) if taken else []
    added = []
    for low, high in regions(text) if weights else ():
        for start, end, kind in viterbi(Region(text[low:high]), weights):
            before = int(np.searchsorted(starts, low + end)) - 1
            if before < 0 or tops[before] <= low + start:
                added.append((kind, low + start, low + end))
    return fixed, sorted(fixed + added)


def listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in spans)


def find(docs: DataFrame, weights: dict[str, float], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, counts of base spans per kind, digest of the base spans, all spans as text, n_added."""
    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in schema.split(", ")]
        types = [pa.int64()] * len(KINDS) + [pa.string(), pa.string(), pa.int64()]
        for batch in batches:
            rows = []
            for body in batch.column(1).to_pylist():
                fixed, every = spans_of(body, weights) if _TRIGGER.search(body) else ([], [])
                counts = [sum(s[0] == k for s in fixed) for k in range(len(KINDS))]
                digest = hashlib.sha256(listed(fixed).encode()).hexdigest()
                rows.append((*counts, digest, listed(every), len(every) - len(fixed)))
            if rows:
                columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
                # ids stay Arrow values: other frames turn longs beside a NULL into doubles
                yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=names)

    texts = docs.select(F.col(doc_id).cast("long").alias("_pii_id"), whole(text).alias("_pii_text"))
    return texts.mapInArrow(run, schema)
