import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from tessera.llm import lm

SPACES = b"\t\n\x0b\x0c\r \xff"


def plain_units(text):
    """Units of a text, each as its mark and bytes, byte by byte."""
    out, unit = [], b"\xff"
    for b in (text or "").encode("utf-8", "surrogatepass").lower() + b"\xff":
        unit += bytes([b])
        if b in SPACES:
            out.append(unit)
            unit = b"\xff"
        elif len(unit) == 25:
            out.append(unit)
            unit = b"\xfe"
    return out


def plain_contexts(trees, unit):
    """(contexts of the predictors, bit) of each decision of a unit."""
    for i in range(1, len(unit)):
        last = unit[:1] * 2 + unit[1:i]
        pair = trees.which[last[-2] * 256 + last[-1]] * 256 + unit[i]
        at = trees.start[pair]
        for node, bit in zip(trees.node[at : at + trees.length[pair]].tolist(), trees.bit[at : at + trees.length[pair]].tolist()):
            past = unit[:1] * max(lm._ORDERS) + unit[1:i]
            yield [(node,), *((k, past[-k:], node) for k in lm._ORDERS), ("all", unit[:i], node)], bit


def plain_model(texts):
    units = Counter(u for t in texts for u in plain_units(t))
    pairs, deeper = np.zeros((256, 256), np.int64), {}
    for u, n in units.items():
        for z, a, b in zip(u[:1] + u, u, u[1:]):
            pairs[a, b] += n
            deeper.setdefault(z * 256 + a, np.zeros(256, np.int64))[b] += n
    assert len(deeper) <= lm._TREES
    trees, counts = lm.build_trees(pairs, deeper)
    assert counts.sum() == pairs.sum() and counts.min() == 0 and counts[:65536].sum() == 0
    ones, total = Counter(), Counter()
    for u, n in units.items():
        for contexts, bit in plain_contexts(trees, u):
            for c in contexts:
                ones[c] += n * bit
                total[c] += n
    return trees, ones, total


def plain_bits(model, text):
    """Bits of a text, decision by decision."""
    trees, ones, total = model
    weights = [[lm.START_WEIGHT] * lm._PREDICTORS for _ in range(lm._GATES)]
    refine = [-8 + 16 * i / (lm._BINS - 1) for i in range(lm._BINS)]
    moves, bits = [], 0.0
    decisions = [d for u in plain_units(text) for d in plain_contexts(trees, u)]
    for at, (contexts, bit) in enumerate(decisions, 1):
        odds, sure = [], []
        for c in contexts:
            n = total[c]
            x = math.log((ones[c] + 0.2) / (n - ones[c] + 0.2)) if n else 0.0
            odds.append(max(-63, min(63, np.rint(x * 8))) / 8)
            sure.append(min(7, math.floor(math.log2(n + 1))) >> 1)
        gate = sure[-2] | sure[-1] << 2
        dot = max(-8, min(8, sum(w * x for w, x in zip(weights[gate], odds))))
        place = int(dot * (lm._BINS - 1) / 16 + lm._BINS / 2)
        sign = 2 * bit - 1
        p = 1 / (1 + math.exp(-sign * (2 * dot + refine[place]) / 3))
        bits -= math.log2(p)
        moves.append((gate, place, sign * (1 - p), odds))
        if at % lm.CHUNK == 0 or at == len(decisions):
            for gate, place, wrong, odds in moves:
                refine[place] += lm.REFINE_RATE * wrong
                for k in range(lm._PREDICTORS):
                    weights[gate][k] += lm.RATE * wrong * odds[k]
            moves = []
    return bits


def some_texts(seed, n, most=120):
    rng = random.Random(seed)
    words = ["alpha", "beta", "Gamma", "delta", "über", "in", "a", "x" * 24, "y" * 23, "z" * 70, "\n", " ", "été"]
    return [rng.choice(["", " "]) + " ".join(rng.choices(words, k=rng.randint(0, most))) for _ in range(n)]


def test_paths_are_a_code():
    trees = plain_model(["abracadabra"])[0]
    for tree in {*trees.which.tolist()}:
        assert sum(0.5 ** int(x) for x in trees.length[tree * 256 : tree * 256 + 256]) == 1
    assert trees.which.max() > 255


def test_units_and_words_match_a_plain_cut():
    texts = [*some_texts(4, 40), "", None, "\x00 \x1f", "a" * 1000, " " * 50]
    split = lm._Split(lm._raw(texts))
    start, stop, mark, keys = split.units()
    want = [u for t in texts for u in plain_units(t)]
    assert [bytes([m]) + split.raw[a:b] for m, a, b in zip(mark.tolist(), start.tolist(), stop.tolist())] == want
    assert len(set(keys.tolist())) == len(set(want)) == len(set(zip(keys.tolist(), want)))
    hashes, sizes = split.words()
    words = [w for t in texts for w in [*(t or "").encode().lower().split(), b"\xff"]]
    assert sizes.tolist() == [len((t or "").encode().split()) + 1 for t in texts]
    assert len(set(hashes.tolist())) == len(set(words)) == len(set(zip(hashes.tolist(), words)))


def test_stretches_of_a_long_text_are_the_text():
    for seed in range(6):
        raw = lm._raw([" ".join(some_texts(seed, 20))])[0] + b"w" * 300 * (seed % 2) + b" end" * (seed % 3)
        whole = lm._Split([raw])
        start, stop, mark, keys = whole.units()
        parts = [p.units()[3] for p in lm._stretches(raw, 24 * 7 + 5 * seed)]
        assert len(parts) > 5 and np.concatenate(parts).tolist() == keys.tolist()
        assert lm._long_words(raw, 100 + seed).tolist() == whole.words()[0].tolist()
        cut = {h for h, a, b in zip(whole.words()[0].tolist(), *zip(*[(0, len(w)) for w in [*raw.split(), b""]])) if b >= 24}
        assert set(lm._cut_words(raw).tolist()) == cut


def test_score_is_that_of_a_plain_version(spark):
    train, texts = some_texts(1, 30), [*some_texts(2, 12), "", None, "unseen letters: qwxzjkv " * 4, "beta " * 400]
    model = plain_model(train)
    docs = spark.createDataFrame([(t,) for t in train], "text string")
    got = lm.train(docs.repartition(3), slot_bits=20)
    assert (got.trees.node == model[0].node).all()
    want = [plain_bits(model, t) for t in texts]
    assert lm.score_bits(got, texts) == pytest.approx(want, rel=0.002)
    rows = spark.createDataFrame([(i, t, 1.0) for i, t in enumerate(texts)], "i int, text string, BITS double")
    assert lm.score(rows, got).columns == ["i", "bits", "n_bytes"]
    scored = {r.i: r for r in lm.score(rows.repartition(2), got).collect()}
    assert [scored[i].bits for i in range(len(texts))] == pytest.approx(want, rel=0.002)


def test_a_text_in_stretches_has_the_score_of_the_whole(spark, monkeypatch):
    docs = spark.createDataFrame([(t,) for t in some_texts(1, 30)], "text string")
    model = lm.train(docs, slot_bits=16)
    text = " ".join(some_texts(3, 40))
    whole = lm.score_bits(model, [text, "alpha"])
    monkeypatch.setattr(lm, "_stretches", lambda raw, cut=lm._stretches: cut(raw, 1000))
    assert lm._alone(lm._Profiles(model), lm._raw([text])[0]) == pytest.approx(whole[0], rel=1e-5)


def test_long_texts_take_bounded_memory(spark):
    import resource

    model = lm.train(spark.createDataFrame([(t,) for t in some_texts(1, 30)], "text string"), slot_bits=14)
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    bits = lm.score_bits(model, ["alpha beta gamma " * 300_000])
    assert bits[0] > 0 and resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 600_000


def test_scores_do_not_depend_on_company_and_adapt_within_a_short_text(spark):
    texts = some_texts(5, 40)
    model = lm.train(spark.createDataFrame([(t,) for t in texts], "text string"), slot_bits=16)
    alone = np.array([lm.score_bits(model, [t])[0] for t in texts])
    assert np.allclose(alone, lm.score_bits(model, texts), rtol=1e-5)
    # The second half of 500 odd bytes costs less than the first: the weights have moved.
    one, two = lm.score_bits(model, ["qjqjx " * 40, "qjqjx " * 80])
    assert two - one < 0.97 * one
    assert lm.CHUNK <= 64 and lm._PREDICTORS >= 6


def test_lanes_are_of_like_length_and_hold_texts_one_after_the_other(monkeypatch):
    monkeypatch.setattr(lm, "_LANES", 8)
    rng = random.Random(7)
    for chunks in ([1], [3, 900, 1], [40] * 5 + [rng.randint(1, 6) for _ in range(200)]):
        order, active, begins = lm._dealt(np.array(chunks))
        assert sorted(order.tolist()) == list(range(sum(chunks))) and sorted(active.tolist(), reverse=True) == active.tolist()
        assert len(active) == len(begins) <= max(max(chunks), 1.05 * sum(chunks) / 8) and active.max() <= 8
        text = np.repeat(np.arange(len(chunks)), chunks)
        firsts, holds, done, at = np.cumsum(chunks) - chunks, {}, Counter(), 0
        for n, begin in zip(active.tolist(), begins):
            now = order[at : at + n].tolist()
            at += n
            assert {lane for lane, c in enumerate(now) if c in firsts} == {*begin.tolist()}
            for lane, c in enumerate(now):
                if lane in begin:
                    assert done[holds.get(lane, -1)] in (0, chunks[holds.get(lane, 0)])
                    holds[lane] = int(text[c])
                assert text[c] == holds[lane] and c - firsts[text[c]] == done[holds[lane]]
                done[holds[lane]] += 1


def test_turns_have_full_lanes_whatever_the_lengths(spark, monkeypatch):
    monkeypatch.setattr(lm, "_LANES", 8, raising=False)
    monkeypatch.setattr(lm, "_GROUP_BYTES", 10**9, raising=False)
    texts = [" ".join(some_texts(i, 12)) for i in range(5)] + some_texts(9, 150, 40) + ["", None]
    model = lm.train(spark.createDataFrame([(t,) for t in texts], "text string"), slot_bits=16)
    alone = [lm.score_bits(model, [t])[0] for t in texts]
    lanes, turn = [], lm._Mixer.turn
    monkeypatch.setattr(lm._Mixer, "turn", lambda self, rows: lanes.append(len(rows)) or turn(self, rows))
    assert lm.score_bits(model, texts) == pytest.approx(alone, rel=1e-5)
    assert max(lanes) <= 8 and np.mean(lanes) > 7


def test_frequent_contexts_keep_their_slots(spark):
    texts = ["common words here again " * 50] * 5 + ["".join(random.Random(i).choices("abcdefghijklmnopqrstuvwxyz ", k=400)) for i in range(60)]
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    tight, wide = lm.train(docs, slot_bits=10), lm.train(docs, slot_bits=20)
    a, b = (lm.score_bits(m, ["common words here again " * 20])[0] for m in (tight, wide))
    assert a == pytest.approx(b, rel=0.1)
    assert lm.train(docs).slot_bits > lm.train(docs.limit(5)).slot_bits


def test_score_documents(spark):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(30)]
    rows = [(i, " ".join(rng.choices(words, k=rng.randint(0, 40))).title()) for i in range(120)]
    rows += [(None, "w1 w2"), (500, None), (501, ""), rows[3], rows[3], (502, "w1 " * 5000), (503, "\x0bunseen\tÉ é"), (504, "long" * 200_000 + " w1"), (505, "w2 " * 300_000 + "b" * 30)]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, bits int, text_key string")
    got = lm.score_documents(docs, slot_bits=12, head_words=7).collect()
    assert len(got) == len(rows)
    out = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    tokens = lambda t: [w.decode() for w in (t or "").encode().lower().split()] + ["\n"]
    counts = Counter(w for i, t in rows if i is not None and not out(i) for w in tokens(t))
    n, v = sum(counts.values()), len(counts)
    want = {i: (out(i), len(tokens(t)), sum(counts[w] > 0 for w in tokens(t)), n, sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in tokens(t))) for i, t in rows}
    for r in got:
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == want[r.doc_id][:4]
        assert r.base_score == pytest.approx(want[r.doc_id][4])
        assert r.score < 0 and r.bits_per_byte > 0
    again = {r.doc_id: r.score for r in lm.score_documents(docs.repartition(3), slot_bits=12).collect()}
    assert all(r.score == pytest.approx(again[r.doc_id], rel=1e-4) for r in got)
    assert lm.score_documents(docs.limit(0), slot_bits=8).count() == 0


def test_held_out_text_takes_fewer_bits_than_its_letters(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    model = lm.train(docs.filter(~lm.held_out("doc_id")))
    bits, size = lm.score(docs.filter(lm.held_out("doc_id")), model).selectExpr("sum(bits) b", "sum(n_bytes) n").first()
    assert bits / size < 2.6
