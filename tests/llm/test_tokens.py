import random

import numpy as np
import pytest

from tessera.llm import tokens


@pytest.mark.parametrize("block_bytes", [2, 6, 64, 1 << 20])
def test_scan_stitches_blocks(spark, tmp_path, block_bytes):
    rng = random.Random(3)
    want = []
    for name in "abc":
        ids, at = [], 0
        for k in range(rng.randint(0, 30)):
            n = rng.choice([0, 0, 1, 2, 7, 50])
            want.append((f"{name}.bin", k, at, n, True))
            ids += [rng.randrange(50000) for _ in range(n)] + [50256]
            at += n + 1
        if name == "b":
            want.append(("b.bin", k + 1, at, 3, False))
            ids += [1, 2, 3]
        (tmp_path / f"{name}.bin").write_bytes(np.array(ids, "<u2").tobytes())
    (tmp_path / "empty.bin").write_bytes(b"")
    files = tokens.token_files(spark, str(tmp_path))
    got = [tuple(r) for r in tokens.scan_token_files(files, block_bytes=block_bytes).collect()]
    assert sorted(got) == sorted(want)


def test_counts_and_round_trip(spark):
    texts = ["The cat sat.", "", None, "é" * 50, "x " * 3000, "<|endoftext|>", "The cat sat."]
    rows = [(i if i != 3 else None, t, 5) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    encoding = tokens._encoding(tokens.TOKENIZER)
    got = {r.doc_id: r.n_tokens for r in tokens.count_tokens(docs, block_bytes=64).collect()}
    assert got == {i: len(encoding.encode_ordinary(t or "")) for i, t, _ in rows}
    from tessera.session import shared_path

    folder = shared_path(spark, "round")
    manifest = tokens.write_token_files(docs, folder)
    found = {(r.file, r.ordinal): r for r in tokens.scan_token_files(tokens.token_files(spark, folder)).collect()}
    for r in manifest.collect():
        with open(f"{folder.removeprefix('file://')}/{r.file}", "rb") as f:
            ids = np.frombuffer(f.read(), "<u2")
        doc = found[r.file, r.ordinal]
        assert encoding.decode(ids[doc.start : doc.start + doc.n_tokens].tolist()) == (dict((i, t) for i, t, _ in rows)[r.doc_id] or "")
    assert tokens.count_tokens(docs.limit(0)).count() == 0


def test_long_white_space_is_one_piece():
    encoding = tokens._encoding(tokens.TOKENIZER)
    plain = lambda t: encoding.encode_ordinary(t)
    rng = random.Random(4)
    kinds = " \n\t\r\u00a0\u3000\x85\x1c"
    for n in (1023, 1024, 1025, 3000, 20000):
        for run in (" " * n, "\n" * n, "".join(rng.choices(kinds, k=n))):
            for text in (run, run + "a", "a" + run, f"a b{run}c{run}", run + "\n.", run + "1" + run):
                assert tokens.encode(encoding, text).tolist() == plain(text)
    for text in (" " * 5_000_000, "\n" * 2_000_000 + "x", "a" + "\t \n" * 700_000 + "b"):
        assert 0 < len(tokens.encode(encoding, text)) <= len(text)
    assert len(tokens.encode(encoding, "")) == 0


def test_long_runs_in_documents(spark):
    docs = spark.createDataFrame([(1, " " * 1_500_000), (2, "x" + "\n" * 1_200_000 + "y")], "doc_id long, text string")
    got = {r.doc_id: r.n_tokens for r in tokens.count_tokens(docs).collect()}
    encoding = tokens._encoding(tokens.TOKENIZER)
    assert got == {i: len(tokens.encode(encoding, t)) for i, t in docs.collect()}
