import random
import re

from tessera.llm import decontaminate as dc

ITEM = "Anna has 12 apples and 5 kg of pears, while Ben has 12 apples too; how many apples do they have together"
VARIANT = "Carl has 30 apples and 7 kg of pears, while Dora has 30 apples too; how many apples do they have together"
MIXED = "Carl has 30 apples and 7 kg of pears, while Dora has 99 apples too; how many apples do they have together"


def plain_windows(words, size=5):
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)}


def test_template(spark):
    row = spark.createDataFrame([(ITEM, None, "3.5 kg, x5 and 1,000." + "7" * 40 + " km")], "a string, b string, c string")
    got = row.select(*[dc.marked_words(row[c]).alias(c) for c in "abc"], dc.marked_words(row.a, True).alias("v"), dc._plain(dc.marked_words(row.c, True)).alias("p")).first()
    assert got.a[:8] == ["\u0004anna", "has", "\u0002", "apples", "and", "\u0002", "\u0003", "of"] and "\u0001ben" in got.a and got.b is None
    assert got.c == got.p == ["\u0002", "\u0003", "x\u0002", "and", "\u0002", "\u0002", "\u0003"][:4] + got.c[4:] and got.c[-1] == "\u0003"
    assert len(got.a) == len(got.v) and "12\u0002" in got.v and "\u0003kg" in got.v


def test_pairs(spark):
    rng = random.Random(2)
    fill = lambda n: " ".join("".join(rng.choices("abcdefgh", k=5)) for _ in range(n))
    docs = [(1, f"{fill(30)} {ITEM} {fill(9)}."), (2, f"{fill(20)}. {VARIANT}. {fill(4)}"), (3, MIXED), (4, fill(200)), (5, None), (6, ""), (7, "too short"), (None, ITEM), (8, ITEM), (8, ITEM), (9, ITEM[: len(ITEM) // 2])]
    table = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, item_id string, h int")
    items = spark.createDataFrame([(1, ITEM), (1, ITEM), (2, "none of these words is there at all, not one"), (3, None), (4, "short")], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in dc.contaminated(table, items).collect()}
    assert sorted(got, key=str) == sorted([(1, 1), (2, 1), (None, 1), (8, 1)], key=str)
    assert got[2, 1].reparameterised and not got[8, 1].reparameterised and got[2, 1].consistency == 1 and got[1, 1].n_slots > 0
    kept = sorted(dc.clean(table, items).collect(), key=str)
    assert len(kept) == 6 and kept[0].asDict().keys() == table.first().asDict().keys()


def test_coverage_matches_brute_force(spark):
    rng = random.Random(4)
    vocab = "red blue green stone river cloud".split()
    items = [(i, " ".join(rng.choices(vocab, k=rng.randint(3, 9)))) for i in range(12)]
    docs = [(i, " ".join(rng.choices(vocab, k=rng.randint(0, 400)))) for i in range(40)]
    want = set()
    for d, text in docs:
        for i, item in items:
            size = min(5, len(item.split()))
            there, asked = (plain_windows(re.findall(r"\w+", t), size) for t in (text, item))
            if asked and len(asked & there) >= 0.8 * len(asked):
                want.add((d, i))
    got = dc.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert want and {(r.doc_id, r.item_id) for r in got.collect()} == want


def test_empty(spark):
    docs = spark.createDataFrame([(1, ITEM)], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert dc.contaminated(docs, none).count() == 0 and dc.clean(docs, none).count() == 1


def test_case_place_and_white_space_do_not_hide_items(spark):
    short = "What is the capital city of France?"
    long = "J. Smith bought 12 red apples at the big market. Anna then ate 3 of them before 5 KG of pears arrived from Spain"
    items = spark.createDataFrame([(1, short), (2, long)], "item_id long, text string")
    docs = [
        (1, f"Question: {short}"), (2, f"text, {short.lower()}"), (3, short.replace(" ", "\n  ")), (4, short.upper()),
        (5, long.replace("Anna", "Berta")), (6, long.replace("Smith", "Miller")), (7, long.lower()), (8, long.replace("5 KG", "5\nkg")),
        (9, "What was the capital of that old city in France?"), (10, f'He said: "{long}"'),
    ]
    got = {(r.doc_id, r.item_id): r for r in dc.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), items).collect()}
    assert sorted(got) == [(1, 1), (2, 1), (3, 1), (4, 1), (5, 2), (6, 2), (7, 2), (8, 2), (10, 2)]
    assert [d for d, i in got if got[d, i].reparameterised] in ([5, 6], [6, 5]) and all(r.coverage == 1 for r in got.values())


def test_short_items_long_numbers_and_names_at_sentence_starts(spark):
    a = "A train goes 200 km. Sue asks how far it goes."
    items = spark.createDataFrame([(1, "Name the capital"), (2, a), (3, "Two words"), (4, "")], "item_id long, text string")
    docs = [(1, "Please name the capital of it"), (2, a.replace("200", "120").replace("Sue", "Bob")), (3, a.replace("200", "9" * 60)), (4, "two words, the capital"), (5, f"x {a}")]
    table = spark.createDataFrame([(*d, 0) for d in docs], "doc_id long, text string, KEY int")
    got = {(r.doc_id, r.item_id): r for r in dc.contaminated(table, items).collect()}
    assert sorted(got) == [(1, 1), (2, 2), (3, 2), (5, 2)] and got[2, 2].reparameterised and not got[5, 2].reparameterised
    assert [r.doc_id for r in dc.clean(table, items).collect()] == [4]


def plain_words(text):
    """Marked words with values, by a scan of words rather than by patterns over the text."""
    out, previous = [], ""
    for raw in re.findall(r"[A-Za-z]+|[0-9]+(?:[.,][0-9]+)*|[^A-Za-z0-9\s]+|\s+", text):
        if raw[0].isdigit():
            out.append(("number", raw))
        elif raw.isalpha() and out and out[-1][0] == "number" and raw.lower() in dc.UNITS and previous in (" ", out[-1][1]):
            out.append(("unit", raw.lower()))
        elif raw.isalpha():
            out.append(("capital" if raw[0].isupper() else "word", raw.lower()))
        previous = raw
    return out


def test_templates_windows_and_slots_match_brute_force(spark):
    rng = random.Random(12)
    names, words, units = "Ann Bob Cid".split(), "red blue stone river goes".split(), "kg km cm".split()

    def text(n):
        out = []
        for _ in range(n):
            kind = rng.random()
            out += [rng.choice(names)] if kind < 0.25 else [str(rng.randint(1, 3)), *([rng.choice(units)] if rng.random() < 0.5 else [])] if kind < 0.5 else [rng.choice(words)]
        return " ".join(out)

    items = [(i, text(rng.randint(2, 8))) for i in range(14)]
    docs = [(i, " ".join(text(rng.randint(0, 30)) for _ in range(2))) for i in range(60)]
    docs += [(100 + i, f"{text(4)} {items[i][1]} {text(4)}") for i in range(14)]
    swap = {"Ann": "Bob", "Bob": "Cid", "Cid": "Ann", "1": "2", "2": "3", "3": "1"}
    docs += [(200 + i, " ".join(swap.get(w, w) for w in items[i][1].split())) for i in range(14)]
    lower = lambda ws: [{"number": 2, "unit": 3}.get(k, w) for k, w in ws]
    named = lambda ws: [{"number": 2, "unit": 3, "capital": 1}.get(k, w) for k, w in ws]
    want = {}
    for i, item in items:
        asked = plain_words(item)
        size = min(5, len(asked))
        if size < 3:
            continue
        cut = lambda ws: [tuple(ws[k : k + size]) for k in range(len(ws) - size + 1)]  # noqa: E731, B023
        for d, doc in docs:
            held = plain_words(doc)
            there = set(cut(lower(held))) | set(cut(named(held)))
            own = {}
            for a, b in zip(cut(lower(asked)), cut(named(asked))):
                own[a] = own.get(a, False) or a in there or b in there
            if sum(own.values()) < 0.8 * len(own):
                continue
            shifts = {}
            for p, (a, b) in enumerate(zip(cut(lower(asked)), cut(named(asked)))):
                for q, (x, y) in enumerate(zip(cut(lower(held)), cut(named(held)))):
                    if {a, b} & {x, y}:
                        shifts.setdefault(q - p, set()).add(p)
            shift = max(shifts, key=lambda s: (len(shifts[s]), -s))
            pairs = {(p + k, p + k + shift) for p in shifts[shift] for k in range(size)}
            forms = {}
            # A capitalised word after a lower-case one is a name whose value must be consistent.
            for p, q in pairs:
                kind, value = asked[p]
                after = p > 0 and asked[p - 1][0] in ("word", "capital", "unit")
                if kind in ("number", "unit") or (kind == "capital" and after):
                    forms.setdefault((kind, value), set()).add(held[q][1])
            consistent = sum(len(x) == 1 for x in forms.values()) / len(forms) if forms else 1
            if consistent >= 0.8:
                want[d, i] = (len(own), sum(own.values()), len(forms), round(consistent, 9))
    got = dc.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id): (r.n_windows, r.n_found, r.n_slots, round(r.consistency, 9)) for r in got} == want
    assert len(want) > 30 and any(r.reparameterised for r in got) and {d for d, _ in want} > {100 + i for i in range(14) if len(plain_words(items[i][1])) >= 3}
