"""Benchmark decontamination by templates, with DataFrame functions only.

Texts become templates: numbers, names and units are replaced by typed placeholders, so that a question with
other parameters keeps its template. Windows of five words are hashed and joined in two forms, in lower case and
with every capitalised word as a name, so that neither case nor what stands before a word decides. Where a document
holds enough of an item's windows, the values in the slots of the best alignment are compared: one value of the
item must always stand for one value of the document, else the likeness is by chance.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm.memory import fresh
from tessera.session import join_checked, materialise

WINDOW = 5
#: Items of fewer template words say nothing in particular and are not searched; items of fewer than WINDOW are one window.
LEAST = 3
#: Least share of an item's windows in a document; least share of an item's values that are replaced in one way.
COVERAGE, CONSISTENCY = 0.8, 0.8

#: Units that may follow a number.
UNITS = (
    "mm cm m km in ft yd mi mg g kg t lb lbs oz ml l s sec min h hr hrs ms days day hours hour minutes minute seconds second "
    "weeks week months month years year usd eur gbp dollars dollar euros euro cents cent pounds pound meters meter metres metre "
    "kilometers kilometres miles mile feet foot inches inch grams kilograms liters litres watts volts percent degrees"
).split()

_NAME, _NUMBER, _UNIT, _FIRST = "\u0001", "\u0002", "\u0003", "\u0004"
_NAME_RE = r"\p{Lu}(?<=[\p{Ll},;:)] \p{Lu})\p{L}*"
_CAPITAL_RE = r"(?<![\p{L}\p{N}\u0001-\u0004])\p{Lu}\p{L}*"
# Repeats of groups are possessive: Java then walks them in a loop, where it would else go down one call each time.
_NUMBER_RE = r"[0-9]++(?:[.,][0-9]++)*+"
_UNIT_RE = rf"(?i)(?<=\u0002) ?({'|'.join(sorted(UNITS, key=lambda u: (-len(u), u)))})(?![\p{{L}}])"
# What lies between words; the second form is for texts in which numbers still stand, whose points and commas are theirs.
_PLAIN_GAP_RE = r"[^\p{L}\p{N}\u0001-\u0004]++"
_GAP_RE = r"(?:[^\p{L}\p{N}\u0001-\u0004.,]|(?<![0-9])[.,]|[.,](?![0-9]))++"


def let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def marked_words(text: Column, values: bool = False) -> Column:
    """The words of a text in lower case, numbers and units replaced, capitalised words marked.

    The mark tells names within a sentence from words that may be capitalised by their place. White space and
    case change no more than marks. With ``values`` a number stands before its placeholder, a unit after it.
    """
    out = F.regexp_replace(F.translate(text, _NAME + _NUMBER + _UNIT + _FIRST, ""), r"[\s\u00a0]+", " ")
    out = F.regexp_replace(out, _NUMBER_RE, ("$0" if values else "") + _NUMBER)
    out = F.when(F.contains(out, F.lit(_NUMBER)), F.regexp_replace(out, _UNIT_RE, f" {_UNIT}" + ("$1" if values else ""))).otherwise(out)
    out = F.regexp_replace(F.regexp_replace(out, _NAME_RE, _NAME + "$0"), _CAPITAL_RE, _FIRST + "$0")
    return F.filter(F.split(F.lower(out), _GAP_RE if values else _PLAIN_GAP_RE), lambda w: w != "")


def _marked(word: Column) -> Column:
    return F.startswith(word, F.lit(_NAME)) | F.startswith(word, F.lit(_FIRST))


def _unmarked(word: Column) -> Column:
    return F.when(_marked(word), F.substring(word, 2, 1 << 30)).otherwise(word)


def _lower(words: Column) -> Column:
    """Marked words as lower-case template words."""
    return F.transform(words, _unmarked)


def _named(words: Column) -> Column:
    """Marked words with every capitalised one as a name."""
    return F.transform(words, lambda w: F.when(_marked(w), F.lit(_NAME)).otherwise(w))


def window_hashes(words: Column, window: int = WINDOW) -> Column:
    """Hashes of all windows of ``window`` words, in order; none in a shorter text."""

    def of(hashes: Column) -> Column:
        places = F.sequence(F.lit(0), F.size(hashes) - window)
        return F.transform(places, lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(window)]))

    hashed = let(F.transform(words, lambda w: F.xxhash64(w)), lambda h: F.when(F.size(h) >= window, of(h)))
    return F.coalesce(hashed, F.array().cast("array<bigint>"))


_SLOT_RE = rf"^[{_NAME}{_UNIT}]|^{_NUMBER_RE}{_NUMBER}$"


def _slot(word: Column) -> Column:
    return F.rlike(word, F.lit(_SLOT_RE))


def _plain(words: Column) -> Column:
    """Marked template words of marked words with their values."""
    return F.transform(words, lambda w: F.when(F.startswith(w, F.lit(_UNIT)), F.lit(_UNIT)).otherwise(F.regexp_replace(w, _NUMBER_RE + _NUMBER, _NUMBER)))


def _placed(words: Column, lengths: list[int]) -> Column:
    """Of each window of marked words with values: its place, its hashes in both forms and its words."""

    def of(length: int) -> Column:
        def placed(plain: Column) -> Column:
            both = F.arrays_zip(window_hashes(_lower(plain), length).alias("a"), window_hashes(_named(plain), length).alias("b"))
            return F.transform(both, lambda z, i: F.struct(i.alias("at"), F.array_distinct(F.array(z.a, z.b)).alias("h"), F.slice(words, i + 1, length).alias("w")))

        return let(_plain(words), placed)

    return F.concat(*[of(n) for n in lengths])


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, coverage: float = COVERAGE, consistency: float = CONSISTENCY, least: int = LEAST) -> DataFrame:
    """``(doc_id, item_id, n_windows, n_found, coverage, n_slots, consistency, reparameterised, text_hash)``.

    A row for each pair of a document and an item of which the document holds at least ``coverage`` of the
    windows, with at least ``consistency`` of the item's slot values replaced in one way (1 without slots). An item
    of fewer than ``window`` template words has one window, all of it; one of fewer than ``least`` words matches
    nothing, nor does a null text; repeated documents or items and ties give one row for each (document id, text,
    item id); a null id stays null; empty tables give no rows; other columns are not looked at. Items' windows are
    broadcast when there are 200,000 at most (counted).
    """
    quiz = items.select(F.col(item_id_col).alias("item_id"), F.col(item_text_col).alias("item_text")).distinct()
    quiz = quiz.select("item_id", "item_text", F.xxhash64("item_text").alias("item_hash"), marked_words(F.col("item_text")).alias("words"))
    quiz = materialise(quiz.filter(F.size("words") >= least).withColumn("length", F.least(F.size("words"), F.lit(window))), "items")
    # At most ``window`` lengths; documents are cut into windows of those that occur.
    lengths = sorted(r[0] for r in quiz.select("length").distinct().collect()) or [window]
    sized = lambda form: F.coalesce(*[F.when(F.col("length") == n, window_hashes(form(F.col("words")), n)) for n in lengths])
    quiz = quiz.select("item_id", "item_text", "item_hash", "length", sized(_lower).alias("hashes"), sized(_named).alias("named"))
    quiz = materialise(quiz.withColumn("n_windows", F.size(F.array_distinct("hashes"))), "item_windows")
    asked = quiz.select("item_id", "item_hash", "n_windows", F.explode(F.arrays_zip("hashes", "named")).alias("z"))
    asked = asked.select("item_id", "item_hash", "n_windows", F.col("z.hashes").alias("own"), F.explode(F.array("z.hashes", "z.named")).alias("h"))
    asked = materialise(asked.distinct(), "windows")

    text = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("doc_text")).withColumn("text_hash", F.xxhash64("doc_text"))

    def both(words: Column, length: int) -> Column:
        pair = F.struct(window_hashes(_lower(words), length).alias("a"), window_hashes(_named(words), length).alias("b"))
        return let(pair, lambda x: F.concat(x.a, F.array_except(x.b, x.a)))

    # Each array is made once.
    found = let(marked_words(F.col("doc_text")), lambda w: F.concat(*[both(w, n) for n in lengths]))
    windows = text.select("doc_id", "text_hash", F.explode(found).alias("h"))
    met = join_checked(windows, asked, "h")
    pair = ["doc_id", "text_hash", "item_id", "item_hash"]
    near = met.groupBy(*pair, "n_windows").agg(F.count_distinct("own").alias("n_found"))
    near = materialise(near.filter(F.col("n_found") >= coverage * F.col("n_windows")), "near")

    known = text.withColumnRenamed("doc_id", "d").withColumnRenamed("text_hash", "t")
    some = materialise(near.select(F.xxhash64("doc_id", "text_hash").alias("k")).distinct(), "found")
    texts = join_checked(known.withColumn("k", F.xxhash64("d", "t")), some, "k", "left_semi").drop("k").distinct()
    full = texts.select("d", "t", marked_words(F.col("doc_text"), values=True).alias("words")).select("d", "t", F.explode(_placed(F.col("words"), lengths)).alias("z"))
    full = full.select("d", "t", F.col("z.at").alias("at"), F.explode("z.h").alias("h"), F.col("z.w").alias("w"))
    asks = quiz.select(F.col("item_id").alias("i"), F.col("item_hash").alias("ih"), "length", "item_text")
    known = near.select(F.col("item_id").alias("some"), F.col("item_hash").alias("some_hash")).distinct()
    asks = asks.join(known, F.col("i").eqNullSafe(F.col("some")) & (F.col("ih") == F.col("some_hash")), "left_semi")
    asks = asks.select("i", "ih", "length", F.explode(_placed(marked_words(F.col("item_text"), values=True), lengths)).alias("z")).filter(F.size("z.w") == F.col("length"))
    asks = materialise(asks.select("i", "ih", F.col("z.at").alias("item_at"), F.explode("z.h").alias("h"), F.col("z.w").alias("item_w")), "asked_windows")
    # Windows meet by their hash first: a document of many windows that holds many items makes no pairs of all of them.
    sides = join_checked(full, asks, "h")
    sides = sides.join(near, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("t")) & F.col("item_id").eqNullSafe(F.col("i")) & (F.col("item_hash") == F.col("ih")))
    lined = sides.select(*pair, "n_windows", "n_found", (F.col("at") - F.col("item_at")).alias("shift"), "item_at", "w", "item_w")
    lined = materialise(lined, "aligned")
    best = lined.groupBy(*pair, "shift").agg(F.count_distinct("item_at").alias("n"))
    best = best.groupBy(*pair).agg(F.max_by("shift", F.struct("n", -F.col("shift"))).alias("best_shift"))
    same = lambda a, b: F.col(f"{a}.doc_id").eqNullSafe(F.col(f"{b}.doc_id")) & F.col(f"{a}.item_id").eqNullSafe(F.col(f"{b}.item_id")) & (F.col(f"{a}.text_hash") == F.col(f"{b}.text_hash")) & (F.col(f"{a}.item_hash") == F.col(f"{b}.item_hash"))
    chosen = lined.alias("a").join(best.alias("b"), same("a", "b") & (F.col("a.shift") == F.col("b.best_shift")))
    slots = chosen.select(*[F.col(f"a.{c}") for c in pair], F.explode(F.arrays_zip("item_w", "w")).alias("z")).select(*pair, F.col("z.item_w").alias("asked"), F.col("z.w").alias("stands"))
    # A word that may be capitalised by its place shows other parameters, but is no value that must be consistent.
    slots = slots.filter(_slot(F.col("asked")) | F.startswith("asked", F.lit(_FIRST))).select(*pair, _slot(F.col("asked")).alias("slot"), _unmarked(F.col("asked")).alias("asked"), _unmarked(F.col("stands")).alias("stands"))
    values = slots.groupBy(*pair, "asked").agg(F.max("slot").alias("slot"), F.count_distinct("stands").alias("forms"), F.max((F.col("asked") != F.col("stands")).cast("int")).alias("other"))
    consistent = F.avg(F.when(F.col("slot"), (F.col("forms") == 1).cast("double")))
    values = values.groupBy(*pair).agg(F.count_if("slot").alias("n_slots"), consistent.alias("consistency"), (F.max("other") == 1).alias("reparameterised"))
    out = near.alias("a").join(values.alias("b"), same("a", "b"), "left")
    out = out.select(
        F.col("a.doc_id"), F.col("a.item_id"), "n_windows", "n_found", (F.col("n_found") / F.col("n_windows")).alias("coverage"),
        F.coalesce("n_slots", F.lit(0)).cast("long").alias("n_slots"), F.coalesce("consistency", F.lit(1.0)).alias("consistency"),
        F.coalesce("reparameterised", F.lit(False)).alias("reparameterised"), F.col("a.text_hash"),
    )
    top = W.partitionBy("doc_id", "text_hash", "item_id").orderBy(F.desc("coverage"), F.desc("consistency"), "n_windows", "n_slots")
    return out.filter(F.col("consistency") >= consistency).withColumn("r", F.row_number().over(top)).filter("r = 1").drop("r")


def clean(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **rules) -> DataFrame:
    """``docs`` without those that hold an item; all else stays, row for row.

    Null and empty texts and null ids stay unless an item is found; of repeated rows all go or stay; columns may have
    any name; empty tables take nothing away.
    """
    key = fresh(docs.columns, "key")
    found = materialise(contaminated(docs, items, id_col, text_col, **rules).select(F.xxhash64("doc_id", "text_hash").alias(key)).distinct(), "contaminated")
    keyed = docs.withColumn(key, F.xxhash64(F.col(id_col), F.xxhash64(F.col(text_col).cast("string"))))
    return join_checked(keyed, found, key, "left_anti").select(*docs.columns)
