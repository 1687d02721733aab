"""Personal data, with DataFrame functions only: four patterns, and terms that give protected values away.

What the patterns find are protected entities. Over the corpus, co-occurrence tells how strongly a term, anywhere in
a text, reveals an entity in it: with P(e) the share of texts that hold the entity and P(e|t) that among the texts
with the term, the term discloses log2 P(e|t) / P(e) bits. Terms above the thresholds are generalised to their kind, or
removed when they all but name the entity. Entities that stand in the very same texts are one class, and so are terms,
so that a text that lists many of both gives a pair of classes and not all pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.memory import fresh
from tessera.session import join_checked, materialise

KINDS = ("email", "ip", "card", "phone")
#: Least texts that a term shares with an entity; least P(e|t); least bits; P(e|t) from which a term is removed.
SUPPORT, GIVEN, BITS, REMOVE = 3, 0.5, 3.0, 0.9

_PART = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])"
#: A start within a run is tried only where the last match ended: elsewhere it would fail like the run's first.
_PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_FIRST = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){12}", "phone": r"\+[0-9]"}
_TERM_GAP, _TERM = r"[^\p{L}\p{N}]+", r"[\p{L}\p{N}]+"
#: Elements that a running sum or a cut of a text handles at a time.
_BLOCK, _PIECE = 64, 1024

_SPANS = "array<struct<start:bigint,stop:bigint,value:string>>"


def let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running(values: Column, combine) -> Column:
    """Running sums, or the like, of an array of longs, block by block, so that the work grows with its size."""
    none = F.array().cast("array<bigint>")
    last = lambda x: F.get(x, F.size(x) - 1)
    grown = lambda acc, x: F.concat(acc, F.array(combine(last(acc), x)))
    starts = lambda v: F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.size(v) / _BLOCK).cast("int") - 1))
    blocks = let(values, lambda v: F.transform(starts(v), lambda b: F.slice(v, b * _BLOCK + 1, _BLOCK)))
    own = F.transform(blocks, lambda block: F.aggregate(block, none, grown))
    carried = lambda x: F.aggregate(x, none, lambda acc, block: F.concat(acc, F.array(F.coalesce(combine(last(acc), last(block)), last(acc)))))
    both = let(own, lambda x: F.arrays_zip(x.alias("own"), F.concat(F.array(F.lit(None).cast("bigint")), carried(x)).alias("before")))
    return F.flatten(F.transform(F.filter(both, lambda z: z.own.isNotNull()), lambda z: F.transform(z.own, lambda x: combine(z.before, x))))


def added(a: Column, b: Column) -> Column:
    return F.coalesce(a, F.lit(0).cast("bigint")) + b


def places(text: Column, pattern: Column) -> Column:
    """Leftmost non-overlapping matches as (start, stop, value), in code points."""
    both = F.arrays_zip(F.regexp_extract_all(text, pattern, F.lit(0)).alias("m"), F.split(text, pattern, -1).alias("gap"))

    def spans(found: Column) -> Column:
        stops = running(F.transform(found, lambda x: (F.length(x.gap) + F.length(x.m)).cast("bigint")), added)
        return F.transform(F.arrays_zip(found.alias("x"), stops.alias("stop")), lambda z: F.struct((z.stop - F.length(z.x.m)).alias("start"), z.stop.alias("stop"), z.x.m.alias("value")))

    return let(F.filter(both, lambda x: x.m.isNotNull()), spans)


def _luhn(digits: Column) -> Column:
    def add(acc: Column, i: Column) -> Column:
        d = F.substr(digits, F.length(digits) - i, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return acc + F.when(i % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), add) % 10 == 0


def _holds(kind: str, value: Column) -> Column:
    if kind == "ip":
        return F.rlike(value, F.lit(rf"^{_PART}\.{_PART}\.{_PART}\.{_PART}$"))
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "card":
        return F.length(digits).between(13, 19) & F.when(F.length(digits).between(13, 19), _luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def base_spans(text: Column, kind: str) -> Column:
    """The spans of one kind in a text, by start; none in a null text."""
    found = F.filter(places(text, F.lit(_PATTERNS[kind])), lambda x: _holds(kind, x.value))
    asked = F.contains(text, F.lit(_FIRST[kind])) if kind == "email" else F.rlike(text, F.lit(_FIRST[kind]))
    return F.when(asked, found).otherwise(F.array().cast(_SPANS))


def terms(text: Column) -> Column:
    """Runs of letters and digits, in lower case."""
    return F.transform(F.filter(F.split(text, _TERM_GAP), lambda t: t != ""), F.lower)


def text_key(text: Column) -> Column:
    return F.struct(F.xxhash64(text).alias("a"), F.hash(text).alias("b"))


def scanned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, text_key, email, ip, card, phone)`` row for row."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.select("doc_id", text_key(F.col("text")).alias("text_key"), *[F.coalesce(base_spans(F.col("text"), k), F.array().cast(_SPANS)).alias(k) for k in KINDS])


def _classes(rows: DataFrame, name: str, support: int) -> DataFrame:
    """``(name, class, n)`` of the values of ``rows(text_key, name)``, distinct, that stand in ``support`` texts or more.

    Values that stand in the same texts, told by their number and two hashes of 64 bits, are one class, named by the least.
    """
    known = rows.groupBy(name).agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("text_key")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "text_key")).alias("y")).filter(F.col("n") >= support)
    least = known.groupBy("n", "x", "y").agg(F.min(name).alias("class"))
    return materialise(known.join(least, ["n", "x", "y"]).select(name, "class", "n"), f"{name}_classes")


def disclosures(docs: DataFrame, found: DataFrame, text_col: str = "text", support: int = SUPPORT, given: float = GIVEN, bits: float = BITS) -> DataFrame:
    """The materialised ``(term, given, bits)`` of the terms that give entities away.

    ``found`` is a materialised :func:`scanned`. Copies of a text count once. The whole corpus is counted, for
    those terms only that can reach the thresholds: an entity and a term must share ``support`` texts, and the term
    stands in at least as many texts as it shares with any entity.
    """
    entity = lambda kind: F.transform(F.col(kind), lambda s: F.concat(F.lit(f"{kind}:"), F.lower(s.value)))
    named = F.concat(*[entity(k) for k in KINDS])
    held = found.filter(F.size(named) > 0).select("text_key", F.explode(named).alias("entity")).distinct()
    held = materialise(held, "entities")
    entities = _classes(held, "entity", support)
    of_texts = materialise(join_checked(held, entities, "entity").select("text_key", F.col("class").alias("entity_class"), F.col("n").alias("n_entity")).distinct(), "entity_texts")
    texts = docs.select(F.col(text_col).cast("string").alias("text")).withColumn("text_key", text_key(F.col("text")))
    some = join_checked(texts, of_texts.select("text_key").distinct(), "text_key", "left_semi")
    words = materialise(some.select("text_key", F.explode(F.array_distinct(terms(F.col("text")))).alias("term")).distinct(), "entity_terms")
    classes = _classes(words, "term", support)
    term_texts = join_checked(words, classes, "term").select("text_key", F.col("class").alias("term_class"), F.col("n").alias("n_beside")).distinct()
    pairs = of_texts.join(term_texts, "text_key").groupBy("entity_class", "term_class", "n_entity", "n_beside").agg(F.count("*").alias("both"))
    pairs = materialise(pairs.filter((F.col("both") >= support) & (F.col("both") >= given * F.col("n_beside"))), "pairs")
    asked = materialise(classes.join(pairs.select(F.col("term_class").alias("class")).distinct(), "class", "left_semi").select("term", "class"), "terms")
    # A text of which there are several copies counts by its share in each, so that counts are summed in each task.
    copies = materialise(found.groupBy("text_key").agg(F.count("*").alias("copies")).filter("copies > 1"), "copies")
    every = join_checked(texts, copies, "text_key", "left").select((1 / F.coalesce("copies", F.lit(1))).alias("share"), F.explode(F.array_distinct(terms(F.col("text")))).alias("term"))
    n_term = join_checked(every, asked.select("term"), "term", "left_semi").groupBy("term").agg(F.round(F.sum("share")).cast("long").alias("n_term"))
    n_texts = found.select("text_key").distinct().count() or 1
    share = F.col("both") / F.col("n_term")
    rows = asked.join(n_term, "term").join(pairs, F.col("class") == F.col("term_class")).withColumn("given", share)
    rows = rows.withColumn("bits", F.log2(share / (F.col("n_entity") / F.lit(n_texts))))
    best = rows.filter((F.col("given") >= given) & (F.col("bits") >= bits)).groupBy("term").agg(F.max("given").alias("given"), F.max("bits").alias("bits"))
    return materialise(best, "disclosing")


_TERM_SPANS = "array<struct<start:bigint,stop:bigint,value:string,given:double>>"


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **thresholds) -> DataFrame:
    """``(doc_id, text_key, email, ip, card, phone, term)`` row for row, each an array of (start, stop, value).

    A term has its P(e|t) beside that, ``given``; its spans do not overlap the patterns'. Null and empty texts have no
    spans; null ids and repeated rows are returned as they come; copies of a text have the same spans; an empty table
    gives an empty result; other columns are not looked at.
    """
    found = materialise(scanned(docs, id_col, text_col), "scanned")
    given_away = disclosures(docs, found, text_col, **thresholds)
    none = F.array().cast(_TERM_SPANS)
    if given_away.isEmpty():
        return found.withColumn("term", none)
    texts = docs.select(F.col(text_col).cast("string").alias("text"))
    words = texts.select(text_key(F.col("text")).alias("k"), "text", F.explode(F.array_distinct(terms(F.col("text")))).alias("term"))
    texts = join_checked(words, given_away.select("term"), "term", "left_semi").select("k", "text").dropDuplicates(["k"])
    words = texts.select("k", F.explode(places(F.col("text"), F.lit(_TERM))).alias("s")).select("k", "s", F.lower("s.value").alias("term"))
    spans = join_checked(words, given_away.select("term", "given"), "term").groupBy("k").agg(F.sort_array(F.collect_list(F.struct("s.start", "s.stop", "s.value", "given"))).alias("term"))
    out = found.join(materialise(spans, "term_spans"), F.col("text_key") == F.col("k"), "left").drop("k")
    base = F.concat(*[F.col(k) for k in KINDS])
    own = F.coalesce("term", none)
    return out.withColumn("term", F.when((F.size(base) > 0) & (F.size(own) > 0), _free(own, base)).otherwise(own))


def _free(terms_: Column, base: Column) -> Column:
    """Those of ``terms_`` that overlap none of ``base``: both are merged by start, and the furthest end before and the next start after carried along."""
    entry = lambda s, value, given: F.struct(s.start.alias("start"), s.stop.alias("stop"), value.alias("value"), given.alias("given"))
    no_value, no_share = F.lit(None).cast("string"), F.lit(None).cast("double")
    both = F.array_sort(F.concat(F.transform(base, lambda s: entry(s, no_value, no_share)), F.transform(terms_, lambda s: entry(s, s.value, s.given))))
    none, furthest = F.lit(-(1 << 62)), lambda a, b: F.greatest(a, b)

    def judged(merged: Column) -> Column:
        ends = running(F.transform(merged, lambda m: F.when(m.value.isNull(), m.stop).otherwise(none)), furthest)
        starts = F.reverse(running(F.transform(F.reverse(merged), lambda m: F.when(m.value.isNull(), -m.start).otherwise(none)), furthest))
        rows = F.arrays_zip(merged.alias("m"), ends.alias("e"), starts.alias("s"))
        kept = F.filter(rows, lambda r: r.m.value.isNotNull() & (r.e <= r.m.start) & (-r.s >= r.m.stop))
        return F.transform(kept, lambda r: r.m)

    return let(both, judged)


def written(kinds: tuple[str, ...]) -> Column:
    """kind:start:end by kind and start, joined by commas, from the columns of :func:`find_pii`."""
    line = lambda kind: F.transform(F.col(kind), lambda s: F.concat_ws(":", F.lit(kind), s.start.cast("string"), s.stop.cast("string")))
    return F.array_join(F.concat(*[line(k) for k in kinds]), ",")


def generalised(value: Column) -> Column:
    """What a term is replaced by: the kind of thing it is."""
    return (
        F.when(F.rlike(value, F.lit(r"^\p{N}+$")), "<NUMBER>").when(F.rlike(value, F.lit(r"\p{N}")), "<CODE>").when(F.rlike(value, F.lit(r"^\p{Lu}")), "<NAME>").otherwise("<TERM>")
    )


def replaced(text: Column, spans: Column) -> Column:
    """A text with each of its spans (start, stop, by), in order, replaced; of spans that overlap the first is."""

    def cut(pieces: Column, low: Column, high: Column) -> Column:
        first = F.floor(low / _PIECE).cast("int")
        some = F.array_join(F.slice(pieces, first + 1, F.floor(high / _PIECE).cast("int") - first + 1), "")
        return F.substr(some, (low % _PIECE + 1).cast("int"), (high - low).cast("int"))

    def joined(pieces: Column) -> Column:
        until = running(F.transform(spans, lambda s: s.stop), lambda a, b: F.greatest(a, b))

        def parts(u: Column) -> Column:
            zero = F.lit(0).cast("bigint")
            before = lambda i: F.coalesce(F.get(u, i - 1), zero)
            put = F.transform(spans, lambda s, i: F.when(s.start >= before(i), F.concat(cut(pieces, before(i), s.start), s.by)).otherwise(""))
            rest = cut(pieces, F.get(u, F.size(u) - 1), F.length(text).cast("bigint"))
            return F.concat(F.array_join(put, ""), rest)

        return let(until, parts)

    return F.when(F.size(spans) > 0, let(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{_PIECE}}}"), F.lit(0)), joined)).otherwise(text)


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", remove: float = REMOVE, **thresholds) -> DataFrame:
    """``docs`` with protected values replaced by <KIND>, and the terms that give them away generalised or removed.

    A term is removed with ``given`` of ``remove`` or more, else replaced by the kind of thing that it is. Row for row:
    null and empty texts stay, repeated rows are treated alike, columns may have any name.
    """
    marked = find_pii(docs, id_col, text_col, **thresholds)
    tag = lambda kind: F.transform(F.col(kind), lambda s: F.struct(s.start.alias("start"), s.stop.alias("stop"), F.lit(f"<{kind.upper()}>").alias("by")))
    term = F.transform("term", lambda s: F.struct(s.start.alias("start"), s.stop.alias("stop"), F.when(s.given >= remove, "").otherwise(generalised(s.value)).alias("by")))
    key, spans = fresh(docs.columns, "key"), fresh(docs.columns, "spans")
    found = marked.select(F.col("text_key").alias(key), F.array_sort(F.concat(*[tag(k) for k in KINDS], term)).alias(spans)).filter(F.size(spans) > 0).dropDuplicates([key])
    rows = docs.withColumn(key, text_key(F.col(text_col).cast("string"))).join(found, key, "left")
    return rows.withColumn(text_col, F.when(F.col(spans).isNotNull(), replaced(F.col(text_col), F.col(spans))).otherwise(F.col(text_col))).select(*docs.columns)
