"""Secret scans: three rules, and a character convolutional network over every other candidate.

A candidate is a run of token characters that is no plain word, or any run after a colon or an equals sign. The
network reads its characters and those around it; it is written in numpy and trained on labelled findings, by
default those that the rules label, in a bounded sample. Half of the positive findings are also shown without their
own context, so that the look of a value counts beside the name before it. Findings are dealt into three parts by
their value: the network learns from the first; on the second a logistic calibration turns its output into a
probability, and the threshold keeps a given recall: it lies halfway from the last finding that is needed for that to
the next negative below; recall and precision are measured on the third.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from tessera.llm.memory import fresh, map_batches, others

KINDS = ("assign", "access", "hex", "model")
_WORDS = ("password", "passwd", "secret", "token", "api")
_ASSIGN = re.compile(r"(?ai:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{32,}")
_RUN = re.compile(r"[A-Za-z0-9+/_.-]{8,}=*")
_PLAIN = re.compile(r"(?:[A-Z]?[a-z]+|[A-Z]+)(?:[.-]+(?:[A-Z]?[a-z]+|[A-Z]+))*")

#: Shortest candidate; characters of context on either side.
SHORTEST, LEFT, RIGHT = 8, 24, 12
#: Labelled findings of either kind in the training sample, at most.
SAMPLE = 3_000
RECALL = 0.95

_ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789 \n=:\"'_-./+@()[]{}<>,;#$%&*!?|\\"
_PIECE, _WIDTH, _EMBED, _FILTERS = 96, 5, 12, 32
_CODES = np.full(0x110000, 1, np.uint8)  # 0: padding, 1: any other character
_CODES[[ord(c) for c in _ALPHABET]] = np.arange(2, 2 + len(_ALPHABET))
_SYMBOLS = 2 * (2 + len(_ALPHABET))  # once as context, once inside the candidate

Span = tuple[str, int, int]


def base_spans(text: str) -> list[Span]:
    """The rules' matches (kind, start, end), by start and then kind."""
    out: list[Span] = []
    lower = text.lower()
    if any(w in lower for w in _WORDS):
        out += [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        out += [("access", m.start(), m.end()) for m in _ACCESS.finditer(text) if len(m[0]) >= 16]
    out += [("hex", m.start(), m.end()) for m in _HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def candidates(text: str) -> Iterator[tuple[int, int]]:
    """Runs of SHORTEST token characters or more, leftmost first, that are no plain words or are assigned to something.

    Plain are letters in lower case, in upper case or with a capital first, and such words joined by dots or hyphens.
    """
    for run in _RUN.finditer(text):
        low, high = run.span()
        while text[high - 1] in ".-/_+":
            high -= 1
            if high == low:
                break
        if high - low >= SHORTEST and (not _PLAIN.fullmatch(text, low, high) or text[max(0, low - 8) : low].rstrip(" \"'")[-1:] in (":", "=")):
            yield low, high


class _Covered:
    """Tells whether a stretch meets any of the spans."""

    def __init__(self, spans: list[Span]) -> None:
        self.low: list[int] = []
        self.high: list[int] = []
        for _, start, end in sorted(spans, key=lambda s: s[1]):
            if self.high and start <= self.high[-1]:
                self.high[-1] = max(self.high[-1], end)
            else:
                self.low.append(start)
                self.high.append(end)

    def meets(self, low: int, high: int) -> bool:
        k = bisect_right(self.high, low)
        return k < len(self.low) and self.low[k] < high


def _encode(text: str, low: int, high: int) -> list[np.ndarray]:
    """The codes of a candidate and its context; a long candidate gives several pieces."""
    first = max(0, low - LEFT)
    points = np.frombuffer(text[first : high + RIGHT].encode("utf-32-le", "surrogatepass"), np.uint32)
    codes = _CODES[points].astype(np.int64)
    codes[low - first : high - first] += _SYMBOLS // 2
    step = _PIECE - LEFT
    return [codes[a : a + _PIECE] for a in range(0, max(1, len(codes) - LEFT), step)]


def _pad(rows: list[np.ndarray]) -> np.ndarray:
    out = np.zeros((len(rows), max([_WIDTH, *map(len, rows)])), np.int64)
    for i, row in enumerate(rows):
        out[i, : len(row)] = row
    return out


@dataclass
class Detector:
    """Weights of the network, its calibration and its threshold."""

    weights: dict[str, np.ndarray]
    slope: float = 1.0
    offset: float = 0.0
    threshold: float = 1.1
    recall: float = 0.0
    precision: float = 0.0

    def raw(self, codes: np.ndarray) -> np.ndarray:
        return _forward(self.weights, codes)[0]

    def probability(self, raw: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * raw + self.offset, -30, 30)))

    def secret(self, found: list[list[np.ndarray]]) -> np.ndarray:
        """Whether each candidate, given by its pieces, is a secret: its most suspect piece decides."""
        owner = np.repeat(np.arange(len(found)), [len(x) for x in found])
        best = np.full(len(found), -np.inf)
        pieces = [p for x in found for p in x]
        for at in range(0, len(pieces), 512):
            np.maximum.at(best, owner[at : at + 512], self.raw(_pad(pieces[at : at + 512])))
        return self.probability(best) >= self.threshold


def _forward(w: dict[str, np.ndarray], codes: np.ndarray) -> tuple:
    x = w["embed"][codes]
    n = codes.shape[1] - _WIDTH + 1
    columns = np.concatenate([x[:, i : i + n] for i in range(_WIDTH)], axis=2)
    conv = np.maximum(columns @ w["filters"] + w["bias"], 0)
    best = conv.argmax(1)
    pooled = np.take_along_axis(conv, best[:, None], 1)[:, 0]
    hidden = np.maximum(pooled @ w["dense"] + w["dense_bias"], 0)
    return hidden @ w["out"] + w["out_bias"][0], columns, best, pooled, hidden


def _gradients(w: dict[str, np.ndarray], codes: np.ndarray, label: np.ndarray) -> dict[str, np.ndarray]:
    raw, columns, best, pooled, hidden = _forward(w, codes)
    d_raw = (1 / (1 + np.exp(-np.clip(raw, -30, 30))) - label) / len(label)
    d_hidden = np.outer(d_raw, w["out"]) * (hidden > 0)
    d_pooled = (d_hidden @ w["dense"].T) * (pooled > 0)
    g = {"out": hidden.T @ d_raw, "out_bias": np.array([d_raw.sum()]), "dense": pooled.T @ d_hidden, "dense_bias": d_hidden.sum(0), "bias": d_pooled.sum(0)}
    rows = np.arange(len(codes))[:, None]
    chosen = columns[rows, best]  # (text, filter, inputs of the filter)
    g["filters"] = np.einsum("bfi,bf->if", chosen, d_pooled)
    d_chosen = d_pooled[:, :, None] * w["filters"].T[None]
    places = best[:, :, None] + np.arange(_WIDTH)[None, None]
    g["embed"] = np.zeros_like(w["embed"])
    np.add.at(g["embed"], codes[rows[:, :, None], places], d_chosen.reshape(*places.shape, _EMBED))
    g["embed"][0] = 0
    return g


def _train_network(codes: list[np.ndarray], labels: np.ndarray, epochs: int = 8, seed: int = 7) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    shape = {"embed": (_SYMBOLS, _EMBED), "filters": (_WIDTH * _EMBED, _FILTERS), "bias": (_FILTERS,), "dense": (_FILTERS, 16), "dense_bias": (16,), "out": (16,), "out_bias": (1,)}
    w = {k: rng.normal(0, 0.0 if "bias" in k else (0.3 if k == "embed" else (2 / s[0]) ** 0.5), s) for k, s in shape.items()}
    w["embed"][0] = 0
    first = {k: np.zeros(s) for k, s in shape.items()}
    second = {k: np.zeros(s) for k, s in shape.items()}
    t = 0
    for _ in range(epochs):
        order = rng.permutation(len(codes))
        for at in range(0, len(order), 64):
            part = order[at : at + 64]
            t += 1
            for k, g in _gradients(w, _pad([codes[i] for i in part]), labels[part]).items():
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                w[k] -= 0.004 * (first[k] / (1 - 0.9**t)) / (np.sqrt(second[k] / (1 - 0.999**t)) + 1e-8)
    return w


def _calibrate(raw: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Logistic regression of the label on the output, with Platt's smoothed targets."""
    up, down = labels.sum(), len(labels) - labels.sum()
    target = np.where(labels > 0, (up + 1) / (up + 2), 1 / (down + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * raw + b, -30, 30)))
        s, e = p * (1 - p) + 1e-9, p - target
        hess = np.array([[(s * raw * raw).sum() + 1e-6, (s * raw).sum()], [(s * raw).sum(), s.sum() + 1e-6]])
        a, b = np.array([a, b]) - np.linalg.solve(hess, [(e * raw).sum(), e.sum()])
    return float(a), float(b)


def _part(value: str) -> int:
    """Which part a value belongs to: 0 learns (three fifths), 1 sets calibration and threshold, 2 measures."""
    return (0, 0, 0, 1, 2)[zlib.crc32(value.encode("utf-8", "surrogatepass")) % 5]


def fit(findings: list[tuple[str, int, int, int]], recall: float = RECALL) -> Detector | None:
    """A detector from findings (text around, start, end, label); None without 20 of either label, or if a part has none of one.

    No value is in two parts, and a positive that is shown in another's context takes that context from its own part.
    """
    rng = np.random.default_rng(11)
    parts: list[list[tuple[str, int, int, int]]] = [[], [], []]
    for finding in findings:
        parts[_part(finding[0][finding[1] : finding[2]])].append(finding)
    labelled = [[[f for f in part if f[3] == k] for k in (0, 1)] for part in parts]
    if min(sum(len(x[k]) for x in labelled) for k in (0, 1)) < 20 or not all(x[k] for x in labelled for k in (0, 1)):
        return None
    rows = []
    for negative, positive in labelled:
        moved = []
        for text, low, high, _ in positive[::2]:
            around, a, b, _ = negative[int(rng.integers(len(negative)))]
            moved.append((around[:a] + text[low:high] + around[b:], a, a + high - low, 1))
        rows.append([*positive, *moved, *negative])
    codes = [[_encode(t, a, b)[0] for t, a, b, _ in part] for part in rows]
    labels = [np.array([f[3] for f in part], float) for part in rows]
    found = Detector(_train_network(codes[0], labels[0]))
    raw = [np.concatenate([found.raw(_pad(part[at : at + 512])) for at in range(0, len(part), 512)]) for part in codes[1:]]
    found.slope, found.offset = _calibrate(raw[0], labels[1])
    ranked = np.sort(raw[0][labels[1] > 0])[::-1]
    least = ranked[min(len(ranked) - 1, int(np.ceil(recall * len(ranked))) - 1)]
    below = raw[0][(labels[1] == 0) & (raw[0] < least)]
    found.threshold = float(found.probability(np.array([(least + below.max()) / 2 if len(below) else least]))[0])
    hit = found.probability(raw[1]) >= found.threshold
    found.recall = float(hit[labels[2] > 0].mean())
    found.precision = float(labels[2][hit].mean()) if hit.any() else 0.0
    return found


def _finding_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["around", "low", "high", "label"]
    for batch in batches:
        rows: list[tuple] = []
        for value in batch.column(0):
            text = value.as_py() or ""
            covered = _Covered(base_spans(text))
            for low, high in candidates(text):
                left = max(0, low - LEFT)
                rows.append((text[left : min(high, low + _PIECE) + RIGHT], low - left, min(high, low + _PIECE) - left, int(covered.meets(low, high))))
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.int32(), pa.int32(), pa.int32()))], names=names)


def findings(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``(around, low, high, label)`` of every candidate of every text; label is one where a rule finds a secret."""
    return map_batches(docs.select(F.col(text_col).alias("text")), _finding_batches, "around string, low int, high int, label int")


def train(docs: DataFrame, text_col: str = "text", labelled: DataFrame | None = None, sample: int = SAMPLE) -> Detector | None:
    """Fit on at most ``sample`` labelled findings of either label, drawn by hash."""
    rows = findings(docs, text_col) if labelled is None else labelled
    rows = rows.dropDuplicates(["around", "low", "high"]).withColumn("h", F.xxhash64("around", "low", "high"))
    both = [rows.filter(F.col("label") == k).orderBy("h", "around", "low").limit(sample).drop("h") for k in (0, 1)]
    return fit(sorted(tuple(r) for r in both[0].union(both[1]).collect()))


def _merge(base: list[Span], low_high: list[tuple[int, int]]) -> list[Span]:
    return sorted([*base, *(("model", a, b) for a, b in low_high)], key=lambda s: (s[1], KINDS.index(s[0])))


def scan(texts: list[str | None], detector: Detector | None) -> list[tuple[list[Span], list[Span]]]:
    """For each text the rules' spans, and all spans with those that the network adds."""
    base = [base_spans(t or "") for t in texts]
    asked, place = [], []
    if detector is not None:
        for i, t in enumerate(texts):
            if t:
                covered = _Covered(base[i])
                for low, high in candidates(t):
                    if not covered.meets(low, high):
                        asked.append(_encode(t, low, high))
                        place.append((i, low, high))
    more: list[list[tuple[int, int]]] = [[] for _ in texts]
    if asked:
        for (i, low, high), yes in zip(place, detector.secret(asked).tolist()):
            if yes:
                more[i].append((low, high))
    return [(b, _merge(b, m)) for b, m in zip(base, more)]


def written(spans: list[Span]) -> str:
    """kind:start:end, joined by commas."""
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def masked(text: str | None, spans: list[Span], by: str = "[SECRET]") -> str | None:
    """The text with each stretch of spans replaced."""
    if not spans:
        return text
    out, at = [], 0
    for _, a, b in sorted(spans, key=lambda s: (s[1], s[2])):
        if a >= at:
            out += [text[at:a], by]
        at = max(at, b)
    return "".join([*out, text[at:]])


OUTPUT = ["base_spans", "spans", "masked_text"]


def find_secrets(docs: DataFrame, detector: Detector | None, text_col: str = "text", output: list[str] = OUTPUT) -> DataFrame:
    """All columns of ``docs`` with ``base_spans``, ``spans`` and ``masked_text``, row for row.

    Spans are written as kind:start:end in code points. Whole texts are scanned; a null text has no spans and
    stays null, an empty one is empty. ``detector`` None adds nothing to the rules. Null ids, repeated rows and
    ties come out as they go in; an empty table gives an empty result. A column of ``docs`` that has the name of an
    output, which ``output`` can change, is left out in its favour.
    """
    known = docs.sparkSession.sparkContext.broadcast(detector)
    rows = docs.select(F.col(text_col).cast("string").alias(fresh(docs.columns, "text_")), *others(docs.columns, output))
    target = StructType([*rows.schema.fields[1:], *(StructField(c, StringType()) for c in output)])
    names = [f.name for f in target.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                texts = part.column(0).to_pylist()
                found = scan(texts, known.value)
                more = [[written(b) for b, _ in found], [written(s) for _, s in found], [masked(t, s) for t, (_, s) in zip(texts, found)]]
                yield pa.RecordBatch.from_arrays([*part.columns[1:], *(pa.array(x, pa.string()) for x in more)], names=names)

    return map_batches(rows, run, target)


def mask(docs: DataFrame, detector: Detector | None, text_col: str = "text", chars_col: str = "n_chars") -> DataFrame:
    """``docs`` with the secrets in their texts replaced, and the length in ``chars_col`` set anew where a text changed.

    Row for row: null and empty texts, null ids, repeated rows and columns of any name come out as they go in, and an
    empty table gives an empty result.
    """
    base, spans, text = output = [fresh(docs.columns, c) for c in OUTPUT]
    found = find_secrets(docs, detector, text_col, output)
    changed = F.coalesce(F.col(spans) != "", F.lit(False))
    if chars_col in docs.columns:
        found = found.withColumn(chars_col, F.when(changed, F.length(text).cast(docs.schema[chars_col].dataType)).otherwise(F.col(chars_col)))
    return found.withColumn(text_col, F.when(changed, F.col(text)).otherwise(F.col(text_col))).select(*docs.columns)
