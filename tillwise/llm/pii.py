"""PII: candidate spans, scored by boosted trees over format and context, cut by calibrated thresholds.

Generators with high recall propose spans, which may overlap: anything with an at sign, digits with
separators, dotted numbers, and long tokens that hold a digit. Features describe a candidate's
format (lengths, groups, checksums, ranges) and its context (characters around it, hints in the
words before). There are no labels for personal data, so trees learn from the rules:
candidates that the strict base patterns take, and tokens assigned to a secret's name, are positive.
They judge by looks and context, and so also find what misses a pattern by a letter.

Candidates with equal features count once. Trees are fitted on a bounded sample of three quarters of
them, in which each generator and label has its share, so kinds that are rare in a large table are
learnt too. Calibration and thresholds come from the last quarter, counted over the whole table by
generator, bin of score and label. A generator's threshold is the lowest probability from which
held-out candidates are right ``PRECISION`` of the time; its own count as they are and the rate of all
generators as ``POOLED`` more, so a generator with few has the common threshold. Base spans always
stay; a further one is added if it reaches its threshold and overlaps no base span and no better
candidate.

Defined results: a null or empty text has no spans. Repeated rows each get their row. If the
candidates are of one class only, no spans are added; if the three quarters are, trees are fitted on
all, and the threshold is ``PRECISION`` as nothing is held out. Further columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, insort
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillwise.llm.boosting import Trees, boost, calibrate
from tillwise.llm.common import store

KINDS = ("email", "ip", "card", "phone")
GENERATORS = ("address", "number", "dotted", "secret")
#: The fit sample: so many candidates at most.
FIT_CANDIDATES = 40_000
PRECISION = 0.98
#: So many held-out candidates the rate of all generators counts for in that of one.
POOLED = 20
#: Scores are counted in bins of 1 / BINS, up to TOP on both sides of 0.
BINS, TOP = 16, 32
CONTEXT = 24

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match can only begin where a run of digits begins: whether one follows doesn't depend on where
# in the run it starts. Possessive runs keep long ones linear.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_ANY = re.compile(r"[0-9@]")

_ADDRESS = re.compile(r"[^\s@]{1,64}+@[^\s@]+")
_NUMBER = re.compile(r"[+(]?[0-9][0-9\x20().\-/]{5,40}[0-9]")
_DOTTED = re.compile(r"(?<![0-9.])[0-9]++(?:\.[0-9]++){2,}")
_SECRET = re.compile(r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{16,}+")
_NAMED = re.compile(r"(?:key|token|secret|password|passwd|pwd)[\"']?\s*[:=]\s*[\"']?$", re.IGNORECASE)
_HINTS = tuple(
    re.compile(words, re.IGNORECASE)
    for words in (r"mail", r"phone|tel|call|mobile", r"card|visa|credit", r"\bip\b|host|addr", r"key|token|secret|pass|pwd")
)


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches in order: the run of local characters before an at sign, and a domain after it."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield start, domain.end()
            done = domain.end()
        else:
            done = at + 1 if start == at else done
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) of the strict patterns, by start and then as kinds are listed."""
    found = [(a, "email", b) for a, b in _emails(text)]
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            found.append((m.start(), "ip", m.end()))
    for m in _CARD.finditer(text):
        digits = _digits(m[0])
        if 12 <= len(digits) <= 19 and luhn(digits):
            found.append((m.start(), "card", m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_digits(m[0])) <= 15:
                found.append((m.start(), "phone", m.end()))
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[1])))


def candidates(text: str) -> list[tuple[int, int, int]]:
    """(start, end, generator) of everything that might be personal data."""
    found = [(m.start(), m.end(), 0) for m in _ADDRESS.finditer(text)] if "@" in text else []
    found += [(m.start(), m.end(), 1) for m in _NUMBER.finditer(text)]
    found += [(m.start(), m.end(), 2) for m in _DOTTED.finditer(text)]
    if any(len(w) >= 16 for w in text.split()):
        found += [(m.start(), m.end(), 3) for m in _SECRET.finditer(text) if any(c.isdigit() for c in m[0])]
    return found


def features(text: str, start: int, end: int, generator: int) -> list[int]:
    """Whole numbers from 0 to 255 on a candidate's format and context."""
    span, before, after = text[start:end], text[max(0, start - CONTEXT) : start], text[end : end + 1]
    digits, groups = _digits(span), [len(g) for g in re.findall("[0-9]+", span)]
    head, _, tail = span.rpartition("@")
    parts = span.split(".")
    out = [
        generator, len(span), len(digits), sum(c.isalpha() for c in span), sum(c.isupper() for c in span),
        sum(not c.isalnum() for c in span), len(groups), max(groups, default=0), min(groups, default=0),
        span[0] == "+", span[0] == "(", span.count("."), span.count("-"), span.count(" "), span.count("/"),
        len(head), len(tail), tail.count("."), len(tail.rpartition(".")[2]), span[-1].isalnum(),
        luhn(digits) if digits else 0, max((int(p[:4]) // 4 for p in parts if p.isascii() and p.isdigit()), default=0),
        len(set(span)), before[-1:].isspace() or not before, before[-1:] in "\"'=:", after.isspace() or not after,
        after in "\"',.;", bool(_NAMED.search(before)),
        *[bool(h.search(before)) for h in _HINTS],
    ]
    return [min(255, int(v)) for v in out]


def weak_label(text: str, start: int, end: int, generator: int, base: set[tuple[int, int]]) -> int:
    """What the rules say of a candidate: a base span, punctuation after it aside, or a named secret."""
    if generator == 3:
        return int(bool(_NAMED.search(text[max(0, start - CONTEXT) : start])))
    trimmed = end - (len(text[start:end]) - len(text[start:end].rstrip(".,;:)")))
    return int((start, end) in base or (start, trimmed) in base)


@dataclass(frozen=True)
class Detector:
    trees: Trees | None
    slope: float
    shift: float
    thresholds: tuple[float, ...]

    def added(self, text: str, base: list[tuple[int, str, int]]) -> list[tuple[int, str, int]]:
        """Spans that the trees add to the base ones."""
        if self.trees is None:
            return []
        covered = _merged(base)
        found = [c for c in candidates(text) if _is_free(covered, c[0], c[1])]
        if not found:
            return []
        raw = self.trees.raw(np.array([features(text, *c) for c in found], np.int64))
        chance = 1 / (1 + np.exp(-np.clip(self.slope * raw + self.shift, -40, 40)))
        taken: list[tuple[int, str, int]] = []
        ends: list[tuple[int, int]] = []
        for p, (a, b, g) in sorted(zip(chance.tolist(), found), key=lambda x: (-x[0], x[1])):
            if p >= self.thresholds[g] and _is_free(ends, a, b):
                insort(ends, (a, b))
                taken.append((a, GENERATORS[g], b))
        return taken


def _merged(spans: list[tuple[int, str, int]]) -> list[tuple[int, int]]:
    """What spans sorted by start cover, as stretches apart from each other."""
    out: list[tuple[int, int]] = []
    for a, _, b in spans:
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def _is_free(taken: list[tuple[int, int]], start: int, end: int) -> bool:
    """Whether none of the sorted stretches, which don't overlap, shares a place with this one."""
    at = bisect_left(taken, (end,))
    return at == 0 or taken[at - 1][1] <= start


def fit(documents: DataFrame, fit_candidates: int = FIT_CANDIDATES) -> Detector:
    """Fits trees on a sample, calibration and thresholds on counts of all held-out candidates. The
    driver gets features of the sample and counts only."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = set()
            for text in batch["text"].to_pylist():
                base = {(a, b) for a, _, b in base_spans(text)}
                rows |= {(bytes(features(text, *c)), weak_label(text, *c, base)) for c in candidates(text)}
            columns = list(zip(*((x, y, x[0], (x[1] * 31 + sum(x)) % 4 == 0) for x, y in rows))) if rows else [[]] * 4
            kinds = [pa.binary(), pa.int32(), pa.int32(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["x", "y", "generator", "unseen"])

    telling = documents.where(F.col("text").rlike("[0-9@]")).select("text")
    found = store(telling.mapInArrow(of, "x binary, y int, generator int, unseen boolean").distinct())
    counts = {(r["generator"], r["y"], r["unseen"]): r["count"] for r in found.groupBy("generator", "y", "unseen").count().collect()}
    if len({y for _, y, _ in counts}) < 2:
        return Detector(None, 1.0, 0.0, (2.0,) * len(GENERATORS))
    held_out = len({y for _, y, unseen in counts if not unseen}) == 2
    fitted: dict[tuple[int, int], int] = {}
    for (generator, label, unseen), n in counts.items():
        if not (unseen and held_out):
            fitted[generator, label] = fitted.get((generator, label), 0) + n
    seen = found.where(~F.col("unseen")) if held_out else found
    x, y = [], []
    for (generator, label), n in _shares(fitted, fit_candidates).items():
        own = seen.where((F.col("generator") == generator) & (F.col("y") == label))
        rows = own.select("x").orderBy(F.xxhash64("x"), "x").limit(n).toPandas()
        x += [np.frombuffer(b, np.uint8) for b in rows.x]
        y += [float(label)] * len(rows)
    trees = boost(np.array(x, np.int64), np.array(y))
    held = _held_out(found.where("unseen"), trees) if held_out else np.zeros((0, 4), np.int64)
    if not len(held):
        return Detector(trees, 1.0, 0.0, (PRECISION,) * len(GENERATORS))
    slope, shift = calibrate((held[:, 1] + 0.5) / BINS, held[:, 2].astype(float), held[:, 3].astype(float))
    return Detector(trees, slope, shift, _thresholds(held, slope, shift))


def _shares(counts: dict[tuple[int, int], int], most: int) -> dict[tuple[int, int], int]:
    """How many of each are taken so that no more than ``most`` are: equally many, and what small
    ones leave goes to the others."""
    taken = {}
    for k, (key, n) in enumerate(sorted(counts.items(), key=lambda c: (c[1], c[0]))):
        taken[key] = min(n, (most - sum(taken.values())) // (len(counts) - k))
    return taken


def _held_out(found: DataFrame, trees: Trees) -> np.ndarray:
    """Rows (generator, bin of score, label, count) over all candidates given."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            raw = trees.raw(np.array([np.frombuffer(b, np.uint8) for b in batch["x"].to_pylist()], np.int64))
            bins = np.floor(np.clip(raw, -TOP, TOP) * BINS).astype(np.int64)
            rows = np.stack([batch["generator"].to_numpy(), bins, batch["y"].to_numpy()], 1)
            rows, times = np.unique(rows, axis=0, return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [*[pa.array(c, pa.int32()) for c in rows.T], pa.array(times, pa.int64())], ["generator", "bin", "y", "times"]
            )

    counted = found.mapInArrow(of, "generator int, bin int, y int, times long").groupBy("generator", "bin", "y").agg(F.sum("times"))
    return np.array(sorted(map(tuple, counted.collect())), np.int64).reshape(-1, 4)


def _thresholds(held: np.ndarray, slope: float, shift: float) -> tuple[float, ...]:
    """For each generator the lowest probability from which held-out candidates are right often
    enough; 2, which none reaches, where they never are."""
    bins = np.unique(held[:, 1])[::-1]

    def above(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many score in each bin or a higher one, and how many of them are right."""
        at = np.searchsorted(-bins, -rows[:, 1])
        counts = (np.bincount(at, w, len(bins)) for w in (rows[:, 3], rows[:, 2] * rows[:, 3]))
        return tuple(np.cumsum(c) for c in counts)

    n, right = above(held)
    out = []
    for generator in range(len(GENERATORS)):
        own, own_right = above(held[held[:, 0] == generator])
        good = np.flatnonzero(own_right + POOLED * right / n >= PRECISION * (own + POOLED))
        if slope <= 0 or not len(good):
            out.append(2.0)
        else:
            chance = 1 / (1 + np.exp(-np.clip(slope * bins[good[-1]] / BINS + shift, -40, 40)))
            out.append(max(0.5, float(chance)))
    return tuple(out)


def _listed(spans: list[tuple[int, str, int]]) -> str:
    order = (*KINDS, *GENERATORS)
    return ",".join(f"{k}:{a}:{b}" for a, k, b in sorted(spans, key=lambda s: (s[0], order.index(s[1]))))


def pii(documents: DataFrame, detector: Detector | None = None) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_spans) of every row."""
    detector = detector or fit(documents)
    nothing = (*(0,) * len(KINDS), hashlib.sha256(b"").hexdigest(), "", 0)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for scalar in batch["text"]:
                text = scalar.as_py() or ""
                if not _ANY.search(text):
                    rows.append(nothing)
                    continue
                base = base_spans(text)
                counts = [sum(k == kind for _, k, _ in base) for kind in KINDS]
                sha = hashlib.sha256(_listed(base).encode()).hexdigest()
                spans = [*base, *detector.added(text, base)]
                rows.append((*counts, sha, _listed(spans), len(spans)))
            columns = list(zip(*rows)) if rows else [[]] * 7
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], *[pa.array(c, t) for c, t in zip(columns, kinds)]],
                ["doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans", "n_spans"],
            )

    schema = "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_spans long"
    given = documents.select("doc_id", "text")
    return given.mapInArrow(of, f"doc_id {given.schema['doc_id'].dataType.simpleString()}, {schema}")


def redacted(documents: DataFrame, detector: Detector | None = None) -> DataFrame:
    """The documents with every span replaced by its kind in brackets, with all their columns."""
    detector = detector or fit(documents)

    @F.pandas_udf("string")
    def cut(texts):
        def one(text):
            if text is None or not _ANY.search(text):
                return text
            base, out, at = base_spans(text), [], 0
            for a, kind, b in sorted([*base, *detector.added(text, base)], key=lambda s: (s[0], -s[2])):
                if a >= at:
                    out += [text[at:a], f"[{kind}]"]
                at = max(at, b)
            return "".join(out) + text[at:]

        return texts.map(one, na_action="ignore")

    return documents.withColumn("text", cut("text"))
