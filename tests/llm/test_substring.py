import random

import numpy as np
from common_cases import CLASH, HOSTILE, documents

from loomql.llm import substring as S


def words(rng, n):
    return ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(3, 8))) for _ in range(n)]


def covered(found, i):
    return {w for r in found if r["doc_id"] == i for w in range(r["first_word"], r["end_word"])}


def test_planted_passages_against_brute_force(spark):
    """Every run of 50 words that documents share is found in all but one."""
    rng = random.Random(7)
    passages = [words(rng, n) for n in (50, 51, 60, 120, 300)]
    texts = {}
    for i in range(60):
        body = words(rng, rng.randint(30, 200))
        for p in rng.sample(passages, rng.choice([0, 0, 1, 2])):
            at = rng.randint(0, len(body))
            body[at:at] = p
        texts[i] = body
    texts[100] = texts[0]  # a whole copy
    texts[101] = ["same"] * 90
    texts[102] = ["same"] * 80
    rows = [(i, " ".join(t)) for i, t in texts.items()]
    found = S.passages(documents(spark, rows)).collect()
    have = {i: covered(found, i) for i in texts}
    runs = {}
    for i, t in texts.items():
        for at in range(len(t) - 49):
            runs.setdefault(tuple(t[at : at + 50]), []).append((i, at))
    shared = [v for v in runs.values() if len({i for i, _ in v}) > 1]
    assert shared
    for places in shared:
        left = {i for i, at in places if not set(range(at, at + 50)) <= have[i]}
        assert len(left) <= 1
    short = {}
    for i, t in texts.items():
        for at in range(len(t) - 11):
            short.setdefault(tuple(t[at : at + 12]), []).append((i, at))
    marked = {i: set() for i in texts}
    for places in short.values():
        if len({i for i, _ in places}) > 1:
            for i, at in places:
                marked[i] |= set(range(at, at + 12))
    assert all(have[i] <= marked[i] for i in texts)  # and nothing that documents don't share
    assert all(r["kept_doc_ids"] and r["doc_id"] not in r["kept_doc_ids"] for r in found)


def test_fuzzy_passages(spark):
    rng = random.Random(8)
    passage = words(rng, 100)
    rows = []
    for i in range(30):
        p = list(passage)
        if i:
            for at in rng.sample(range(100), 3):
                p[at] = rng.choice(["changed", "other"])
            p.insert(rng.randint(20, 80), "inserted")
            del p[rng.randint(20, 80)]
        rows.append((i, " ".join(words(rng, 60) + p + words(rng, 60))))
    found = S.passages(documents(spark, rows)).collect()
    hit = [len(covered(found, i) & set(range(60, 160))) for i in range(30)]
    assert sum(n >= 60 for n in hit) >= 24 and sum(n == 0 for n in hit) <= 4
    assert all(len(covered(found, i) - set(range(55, 165))) == 0 for i in range(30))
    clean = [(i, " ".join(words(rng, 300))) for i in range(40)]
    assert S.passages(documents(spark, clean)).count() == 0


def test_chains_are_best():
    """Scores against every order of segments."""
    rng = random.Random(9)
    for _ in range(200):
        n = rng.randint(2, 7)
        x0 = np.array([rng.randint(0, 60) for _ in range(n)])
        size = np.array([rng.randint(1, 12) for _ in range(n)])
        y0 = np.array([rng.randint(0, 60) for _ in range(n)])
        x1, y1 = x0 + size, y0 + size

        def link(i, j):
            return x1[j] <= x0[i] and y1[j] <= y0[i]

        score = size.astype(float)
        for i in np.argsort(x0, kind="stable"):
            gains = [score[j] - S.GAP_COST * (x0[i] - x1[j] + y0[i] - y1[j]) for j in range(n) if link(i, j)]
            score[i] = size[i] + max([0.0, *gains])
        chains = S.chain(x0, x1, y0, y1, size)
        assert sorted(sum(chains, [])) == list(range(n))
        c = chains[0]
        got = size[c[0]] + sum(size[b] - S.GAP_COST * (x0[b] - x1[a] + y0[b] - y1[a]) for a, b in zip(c, c[1:]))
        assert all(link(b, a) for a, b in zip(c, c[1:])) and abs(got - score.max()) < 1e-9


def test_seeds_cover_every_window():
    rng = np.random.default_rng(3)
    word, row = rng.integers(0, 2**63, 400).astype(np.uint64), np.sort(rng.integers(0, 6, 400))
    h, of, at = S.seeds_of(word, row, S.K, S.W)
    for r in range(6):
        place = np.flatnonzero(row == r)
        mine = at[of == r]
        for a in place[: max(0, len(place) - S.W - S.K + 2)]:
            assert ((mine >= a) & (mine < a + S.W)).any()


def test_cut(spark):
    rng = random.Random(10)
    shared, mine, other = words(rng, 80), words(rng, 40), words(rng, 40)
    rows = [(1, " ".join(mine[:20] + shared + mine[20:]) + "."), (2, "É " + " ".join(other[:20]) + ": " + " ".join(shared) + ", " + " ".join(other[20:])), (3, " ".join(shared))]
    docs = documents(spark, rows, extra=CLASH)
    got = {r["doc_id"]: r for r in S.cut(docs).collect()}
    text = dict(rows)
    whole = [i for i in got if " ".join(shared) in got[i]["text"]]
    assert len(whole) == 1 and got[whole[0]]["text"] == text[whole[0]]  # one copy stays
    for i, own in ((1, mine), (2, other)):
        if i in got and i != whole[0]:
            assert all(w in got[i]["text"] for w in own) and got[i]["n_chars"] == len(got[i]["text"])
    assert 3 in whole or 3 not in got  # nothing remains of a copy alone


def test_cases(spark):
    for kind in ("long", "string"):
        docs = documents(spark, [*HOSTILE, (60, "word " * 9000)], kind, CLASH)
        got = S.cut(docs)
        assert got.columns == docs.columns
        ids = [str(r["doc_id"]).lstrip("d") for r in got.collect()]
        assert ids.count("1") == 3 and ("6" in ids) + ("60" in ids) == 1 and {"2", "3", "4", "5", "None"} <= set(ids)
    assert S.cut(documents(spark, [])).count() == 0 and S.passages(documents(spark, [])).count() == 0
