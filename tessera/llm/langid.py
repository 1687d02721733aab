"""Language ID by cross-parsing entropy.

A bounded sample of labelled text gives one suffix automaton for each language. A text is cut from left to
right into the longest phrases that occur in a language's sample; with c phrases over m characters and a sample
of n characters the cross-parsing entropy is c log2(n) / m. The language with the least entropy wins.
The automata are laid out as transition tables in which a phrase that ends is counted on the way, so that numpy
walks many texts, in segments, through all automata in step.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from tessera.llm.memory import fresh, map_batches, others

UNKNOWN = "und"
#: Characters of labelled text for each language's automaton, at most, and from each document, at most.
SAMPLE_CHARS, DOCUMENT_CHARS = 24_000, 2_000
#: Characters that are one symbol, the most frequent in the samples, at most; all others of the samples are written as a
#: lead symbol, which tells how many follow, and one to three trail symbols. Characters that no sample has are a phrase each.
COMMON, LEADS, TRAILS = 44, (6, 6, 4), 16
SYMBOLS = COMMON + sum(LEADS) + TRAILS + 2
#: Segments of a text that are walked side by side; a phrase ends where a segment ends.
SEGMENT = 1024

_COUNT_SHIFT = 26
_STATE_MASK = (1 << _COUNT_SHIFT) - 1
_BATCH_CHARS = 1_000_000


@dataclass(frozen=True)
class Model:
    """Learned languages, the symbol of each code point and the stacked automata."""

    langs: list[str]
    symbol: np.ndarray  # of a code point: up to four symbols, the first in the lowest byte; 0: other
    table: np.ndarray  # (states, symbols + 1): next state and, above, the phrases that end; the last symbol is no step
    roots: np.ndarray  # of each language
    bits: np.ndarray  # log2 of each sample's length


def _suffix_automaton(symbols: list[int], width: int) -> np.ndarray:
    """Transitions (state, symbol) of the suffix automaton, -1 where there is none."""
    nexts: list[dict[int, int]] = [{}]
    link, length = [-1], [0]
    last = 0
    for c in symbols:
        cur = len(nexts)
        nexts.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in nexts[p]:
            nexts[p][c] = cur
            p = link[p]
        if p >= 0:
            q = nexts[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                clone = len(nexts)
                nexts.append(dict(nexts[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and nexts[p].get(c) == q:
                    nexts[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    out = np.full((len(nexts), width), -1, np.int32)
    for state, step in enumerate(nexts):
        for c, to in step.items():
            out[state, c] = to
    return out


def _parser(step: np.ndarray) -> np.ndarray:
    """The automaton as a parser: a missing transition ends the phrase and starts the next one at the root."""
    root = step[0]
    fresh = np.where(root >= 0, root, 0) | (np.where(root >= 0, 0, 1) << _COUNT_SHIFT)
    table = np.where(step >= 0, step, fresh[None, :] + (1 << _COUNT_SHIFT)).astype(np.int32)
    table[0] = fresh
    return np.concatenate([table, np.arange(len(table), dtype=np.int32)[:, None]], axis=1)


def _codes() -> Iterator[int]:
    """The symbols of the first, second, ... most frequent character, packed with the first in the lowest byte."""
    yield from range(1, COMMON + 1)
    lead, trail = COMMON + 1, COMMON + 1 + sum(LEADS)
    for more, leads in enumerate(LEADS, 1):
        for first in range(lead, lead + leads):
            for k in range(TRAILS**more):
                yield first | sum((trail + k // TRAILS**j % TRAILS) << 8 * (j + 1) for j in range(more))
        lead += leads


def coded(symbol: np.ndarray, points: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The symbols of texts whose code points lie one after the other, and how many each text has."""
    packed = symbol[points]
    if not len(packed) or packed.max() < 256:
        return packed.astype(np.uint8), lengths
    each = 1 + (packed > 0xFF).astype(np.int64) + (packed > 0xFFFF) + (packed > 0xFFFFFF)
    ends = np.append(0, np.cumsum(each))
    place = np.arange(ends[-1]) - np.repeat(ends[:-1], each)
    return (np.repeat(packed, each) >> (8 * place).astype(np.uint32)).astype(np.uint8), np.diff(ends[np.append(0, np.cumsum(lengths))])


def build(samples: dict[str, list[str]]) -> Model:
    """A model from each language's texts."""
    langs = sorted(samples)
    seen = Counter(ch for texts in samples.values() for t in texts for ch in t.lower())
    symbol = np.zeros(0x110000, np.uint32)
    for ch, code in zip(sorted(seen, key=lambda ch: (-seen[ch], ch)), _codes()):
        for form in {ch, ch.upper(), ch.title()}:
            if len(form) == 1 and symbol[ord(form)] == 0:
                symbol[ord(form)] = code
    gap = SYMBOLS - 1
    tables, roots, bits, at = [], [], [], 0
    for lang in langs:
        line: list[int] = []
        for t in samples[lang]:
            points = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32)
            own = coded(symbol, points, np.array([len(points)]))[0].tolist()
            line += [c or gap for c in own] + [gap]
        step = _suffix_automaton(line, SYMBOLS)
        step[:, 0] = step[:, gap] = -1
        table = _parser(step)
        table += at
        tables.append(table)
        roots.append(at)
        bits.append(math.log2(max(2, len(line))))
        at += len(step)
    return Model(langs, symbol, np.concatenate(tables) if tables else np.zeros((0, SYMBOLS + 1), np.int32), np.array(roots, np.int32), np.array(bits))


def _phrases(model: Model, symbols: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Phrases (text, language) of texts whose symbols lie one after the other."""
    text_start = np.cumsum(lengths) - lengths
    pieces = -(-lengths // SEGMENT)
    owner = np.repeat(np.arange(len(lengths)), pieces)
    within = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    start = text_start[owner] + within * SEGMENT
    size = np.minimum(SEGMENT, lengths[owner] - within * SEGMENT)
    order = np.argsort(-size, kind="stable")
    found = np.zeros((len(lengths), len(model.langs)), np.int64)
    width, flat = model.table.shape[1], model.table.ravel()
    padded = np.append(symbols, np.full(SEGMENT, width - 1, np.uint8))
    for at in range(0, len(order), 1024):
        lanes = order[at : at + 1024]
        longest = int(size[lanes[0]])
        grid = padded[start[lanes][None, :] + np.arange(longest)[:, None]]
        grid[np.arange(longest)[:, None] >= size[lanes][None, :]] = width - 1
        state = np.repeat(model.roots[:, None], len(lanes), axis=1)
        count = np.zeros(state.shape, np.int32)
        index, step = np.empty_like(state), np.empty_like(state)
        for row in grid:
            np.multiply(state, width, out=index)
            np.add(index, row[None, :], out=index, casting="unsafe")
            np.take(flat, index, out=step, mode="clip")
            np.bitwise_and(step, _STATE_MASK, out=state)
            np.right_shift(step, _COUNT_SHIFT, out=step)
            np.add(count, step, out=count)
        count += state != model.roots[:, None]
        np.add.at(found, owner[lanes], count.T)
    return found


_LETTER: list[np.ndarray] = []


def _letters() -> np.ndarray:
    if not _LETTER:
        _LETTER.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _LETTER[0]


def predict(model: Model, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
    """The language of each text and a score from 0 to 1, the weight of the winner at 2^-(4 * entropy)."""
    points = [np.frombuffer((t or "").encode("utf-32-le", "surrogatepass"), np.uint32) for t in texts]
    lengths = np.array([len(p) for p in points], np.int64)
    every = np.concatenate(points) if points else np.zeros(0, np.uint32)
    starts = np.cumsum(lengths) - lengths
    lettered = np.append(0, np.cumsum(_letters()[every]))
    has = lettered[starts + lengths] > lettered[starts]
    langs, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
    if not model.langs or not has.any():
        return langs, score
    entropy = _phrases(model, *coded(model.symbol, every, lengths)) * model.bits / np.maximum(lengths, 1)[:, None]
    best = entropy.argmin(1)
    weight = 1 / np.exp2(-4 * (entropy - entropy.min(1, keepdims=True))).sum(1)
    return [model.langs[b] if h else UNKNOWN for b, h in zip(best.tolist(), has.tolist())], np.where(has, weight, 0.0)


def _hash_share(id_col: str, text: F.Column) -> F.Column:
    return F.pmod(F.xxhash64(F.lit("language sample"), F.col(id_col), F.length(text)), F.lit(1_000_000))


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Fit on rows with a text and a label: about SAMPLE_CHARS for each language, from documents drawn by hash.

    One pass counts the rows of each language; the other brings at most a few hundred cut texts a language, which
    differ, to the driver, from which the automata are built. Rows with a null in text or label teach nothing.
    """
    rows = docs.filter(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull() & (F.length(text_col) > 0))
    counts = {r[0]: r[1] for r in rows.groupBy(lang_col).count().collect()}
    if not counts:
        return build({})
    want = 8 * SAMPLE_CHARS // DOCUMENT_CHARS
    share = F.create_map(*[x for k, n in counts.items() for x in (F.lit(k), F.lit(min(1_000_000, math.ceil(1_000_000 * want / n))))])
    drawn = rows.filter(_hash_share(id_col, F.col(text_col)) < share[F.col(lang_col)]).select(
        F.col(lang_col).alias("lang"), F.substring(text_col, 1, DOCUMENT_CHARS).alias("text"), _hash_share(id_col, F.col(text_col)).alias("h")
    )
    first = W.partitionBy("lang").orderBy("h", "text")
    drawn = drawn.distinct().withColumn("r", F.row_number().over(first)).filter(F.col("r") <= 4 * want).drop("r")
    samples: dict[str, list[str]] = {k: [] for k in counts}
    left = dict.fromkeys(counts, SAMPLE_CHARS)
    for lang, text, _ in sorted((tuple(r) for r in drawn.collect()), key=lambda r: (r[0], r[2], r[1])):
        if left[lang] > 0:
            samples[lang].append(text[: left[lang]])
            left[lang] -= len(text)
    return build({k: v for k, v in samples.items() if v})


def training_rows(id_col: str = "doc_id") -> F.Column:
    """True for rows that may teach: crc32 of the id as text, modulo three, is not one; never with a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 != 1, F.lit(False))


OUTPUT = ["lang_pred", "lang_score"]


def identify(docs: DataFrame, model: Model, text_col: str = "text", output: list[str] = OUTPUT) -> DataFrame:
    """All columns of ``docs`` with ``lang_pred`` and ``lang_score``, row for row.

    Whole texts are parsed. A text that is null or has no letter, or any text without a learned language, is
    ``und`` with score 0. Ties go to the first language in code point order. Null ids and repeated rows come out as
    they go in; an empty table gives an empty result. A column of ``docs`` that has the name of an output, which
    ``output`` can change, is left out in its favour.
    """
    known = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col(text_col).cast("string").alias(fresh(docs.columns, "text_")), *others(docs.columns, output))
    target = StructType([*rows.schema.fields[1:], StructField(output[0], StringType()), StructField(output[1], DoubleType())])
    names = [f.name for f in target.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.array([len(x.as_py() or "") for x in batch.column(0)], np.int64)
            cuts = np.flatnonzero(np.diff(np.cumsum(sizes) // _BATCH_CHARS, prepend=0)).tolist()
            for a, b in zip([0, *cuts], [*cuts, batch.num_rows]):
                part = batch.slice(a, b - a)
                if part.num_rows:
                    langs, scores = predict(known.value, part.column(0).to_pylist())
                    yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.array(langs, pa.string()), pa.array(scores)], names=names)

    return map_batches(rows, run, target)


def recognised(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that have a language, with their own columns, whatever those are called."""
    output = [fresh(docs.columns, c) for c in OUTPUT]
    return identify(docs, model, text_col, output).filter(F.col(output[0]) != UNKNOWN).select(*docs.columns)
