import random

from common_cases import CLASH, HOSTILE, documents

from loomql.llm import pieces, tokens


def counts(df):
    return sorted(((r["doc_id"], r["n_tokens"]) for r in df.collect()), key=str)


def whole(rows):
    e = tokens.counter(tokens.FOLDER).encoding
    return sorted(((i, None if t is None else len(e.encode_ordinary(t))) for i, t in rows), key=str)


def test_spliced_counts_are_those_of_whole_texts(spark):
    rng = random.Random(4)
    alphabet = ["the", " ", "  ", "\n", "don't", "é", "日本", "123", "!!", "x" * 40, "\t", "a"]
    rows = [(i, "".join(rng.choices(alphabet, k=rng.choice([3, 60, 400])))) for i in range(120)]
    rows += [(900, "x" * 9000), (901, "x" * 9000), (901, "x" * 9000), (902, "ab " * 4000), (903, " " * 5000)]
    docs = documents(spark, rows)
    got = tokens.token_counts(docs, chunk=100, overlap=24)
    assert counts(got) == whole(rows)
    assert max(r["n_chunks"] for r in got.collect()) > 3


def test_only_huge_texts_and_a_widening_pass(spark):
    rows = [(1, "x" * 9000)]
    got = tokens.token_counts(documents(spark, rows).coalesce(1), chunk=500, overlap=32).collect()
    assert [(r["doc_id"], r["n_tokens"]) for r in got] == whole(rows) and got[0]["n_chunks"] < 10


def test_token_cases(spark):
    for kind in ("long", "string"):
        docs = documents(spark, HOSTILE, kind, CLASH)
        rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
        assert counts(tokens.token_counts(docs)) == whole(rows) and counts(tokens.token_counts(docs, chunk=300, overlap=30)) == whole(rows)
    assert tokens.token_counts(documents(spark, [])).count() == 0


LONG = ["─" * 100, "═" * 30, "…" * 100, "а" * 100, "größe" * 30, "a" * 70 + "é" + "a" * 70, "x" * 63, "x" * 64, "x" * 65, "é" * 32, "é" * 33, "▁ ▁", " lead", "trail "]


def test_round_trip(spark):
    rows = [(i, t) for i, t in enumerate(LONG)] + HOSTILE
    docs = documents(spark, rows, "string", CLASH)
    encoded = pieces.encode(docs)
    key = lambda r: (r["doc_id"] or "", r["text"] or "", r["text"] is None)
    assert sorted(map(key, pieces.decode(encoded).collect())) == sorted(map(key, docs.collect()))
    ids = {(r["doc_id"]): r["ids"] for r in encoded.collect()}
    assert ids["d2"] in (None, ids["d2"]) and pieces.encode(documents(spark, [])).count() == 0
    assert pieces.encode(documents(spark, [(1, None)])).first()["ids"] is None and pieces.encode(documents(spark, [(1, "")])).first()["ids"] == []
    other = {r["doc_id"]: r["ids"] for r in pieces.encode(docs.repartition(5)).collect()}
    assert all(other[k] == v for k, v in ids.items() if k not in ("d1", None, "d2", "d3", "d4", "d5", "d6", "d7", "d8", "d0"))


def test_long_parts_are_drawn_from_the_same_sums():
    import numpy as np

    la = pieces.lattice(pieces.MODEL, 1.0)
    for t in ("größe" * 9, "é" * 25, "─" * 15, "aaaa" * 12):
        x = np.frombuffer((" " + t).encode(), np.uint8)
        cuts = la.cuts(x, np.array([0, len(x)]))
        ends = np.append(cuts[1:], len(x))
        for seed in range(20):
            ids, _ = la.encode(x, np.array([0, len(x)]), np.array([seed], np.uint64))
            assert ids.tolist() == sum((la._long(x[a:z], seed, int(a))[::-1] for a, z in zip(cuts, ends)), [])


def test_samples_follow_the_lattice():
    """Shares of sampled segmentations against the products of their weights."""
    import numpy as np
    import pyarrow as pa

    la = pieces.lattice(pieces.MODEL, 1.0)
    text, n = b" cats", 4000
    paths = {}

    def walk(at, ids, weight):
        if at == len(text):
            paths[tuple(ids)] = weight
            return
        for i, raw in enumerate(la.text):
            if raw and text.startswith(raw, at) and not (i in set(la.byte_ids) and bytes([text[at]]) in la.single):
                walk(at + len(raw), [*ids, i], weight * la.weight[i])

    walk(0, [], 1.0)
    seeds = np.random.default_rng(5).integers(0, 2**63, n).astype(np.uint64)
    drawn = pieces.encode_column(pieces.MODEL, 1.0, pa.array(["cats"] * n), seeds).to_pylist()
    total = sum(paths.values())
    for p, w in paths.items():
        share, want = sum(tuple(d) == p for d in drawn) / n, w / total
        assert abs(share - want) < 5 * (want * (1 - want) / n) ** 0.5 + 1e-3


def test_very_long_text_is_drawn_as_its_slices(monkeypatch):
    import numpy as np
    import pyarrow as pa

    text = "some words and größe here " * 300
    seeds = np.array([77], np.uint64)
    want = pieces.encode_column(pieces.MODEL, 1.0, pa.array([text]), seeds).to_pylist()
    monkeypatch.setattr(pieces, "SLICE", 1000)
    assert pieces.encode_column(pieces.MODEL, 1.0, pa.array([text]), seeds).to_pylist() == want
