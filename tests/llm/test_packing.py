import random
from collections import Counter, defaultdict

import pytest
from common_cases import CLASH, HOSTILE, documents

from loomql.llm import packing, sharding, tokens


def greedy(lengths, capacity):
    """Each length to the sequence of lowest cost with room, one by one."""
    held, cost = [[] for _ in range(-(-sum(lengths) // capacity))], defaultdict(float)
    for n in sorted(lengths, reverse=True):
        fit = [i for i in range(len(held)) if capacity - sum(held[i]) >= n]
        if fit:
            i = min(fit, key=lambda i: (cost[i], i))
        else:
            held.append([])
            i = len(held) - 1
        held[i].append(n)
        cost[i] += packing.cost(n)
    return held


def test_runs_are_those_of_one_heap():
    rng = random.Random(1)
    for _ in range(300):
        capacity = rng.choice([7, 16, 50])
        lengths = [rng.randint(1, capacity) for _ in range(rng.randint(0, 80))]
        got, seen = defaultdict(list), Counter()
        for n, rank, count, sequence, token in packing.pack(sorted(Counter(lengths).items(), reverse=True), capacity):
            assert seen[n] == rank
            seen[n] += count
            for i in range(count):
                assert sum(got[sequence + i]) == token
                got[sequence + i].append(n)
        want = greedy(lengths, capacity)
        assert seen == Counter(lengths) and [got[i] for i in range(len(want))] == want


@pytest.mark.parametrize("parts", [1, 7])
def test_against_greedy(spark, parts):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choices(["alpha", "be", "gamma delta", "x1"], k=rng.choice([1, 3, 9, 40])))) for i in range(300)] + [(None, "alpha " * 5)] * 3 + [(2**60 + i, "be be") for i in range(5)]
    docs = documents(spark, rows).repartition(parts)
    got = packing.pack_documents(docs, capacity=64).collect()
    count = tokens.counter(tokens.FOLDER).count
    size = [count(t) for _, t in rows]
    chunks = [min(64, n - at) for n in size for at in range(0, n, 64)]
    held = defaultdict(list)
    for r in got:
        held[r["sequence_id"]].append((r["first_token"], r["n_tokens"]))
    want = greedy(chunks, 64)
    assert sorted(held) == list(range(len(want)))
    for i, spans in held.items():
        spans.sort()
        assert [n for _, n in spans] == want[i] and all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:])) and spans[0][0] == 0
    assert {r["doc_id"] for r in got} == {i for i, _ in rows}  # ids come through whole, also beside a null


def test_cases(spark):
    for kind in ("long", "string"):
        got = packing.pack_documents(documents(spark, HOSTILE, kind, CLASH)).collect()
        assert len({(r["sequence_id"], r["first_token"]) for r in got}) == len(got) and all(r["first_token"] + r["n_tokens"] <= 4096 for r in got)
        assert sum(r["doc_id"] in (1, "d1") for r in got) == 3 and sum(r["doc_id"] in (6, "d6") for r in got) == 3
    assert packing.pack_documents(documents(spark, [])).count() == 0
    assert packing.pack_documents(documents(spark, [(1, None), (2, "")])).count() == 0


def heap(sizes, shards):
    load = [0] * shards
    out = []
    for s in sorted(sizes, reverse=True):
        i = min(range(shards), key=lambda i: (load[i], i))
        load[i] += s
        out.append((s, i))
    return Counter(out), load


def test_sharding_is_that_of_one_heap(spark):
    rng = random.Random(3)
    rows = [(i, "x" * rng.choice([1, 2, 3, 5, 50, rng.randint(1, 900)]) + str(rng.randint(0, 60))) for i in range(900)] + [(5000 + i, "hot " * 30) for i in range(400)] + [(None, None), (None, ""), (1, None)]
    got = sharding.shard(documents(spark, rows).repartition(5), shards=7).collect()
    assert sorted(map(str, (r["doc_id"] for r in got))) == sorted(str(i) for i, _ in rows)
    groups = defaultdict(lambda: [0, set()])
    for r in got:
        groups[r["group_key"]][0] += r["n_bytes"]
        groups[r["group_key"]][1].add(r["shard"])
    assert all(len(s) == 1 for _, s in groups.values())
    want, load = heap([n for n, _ in groups.values()], 7)
    assert Counter((n, next(iter(s))) for n, s in groups.values()) == want
    sums = Counter()
    for r in got:
        sums[r["shard"]] += r["n_bytes"]
    assert [sums[i] for i in range(7)] == load


def test_sharding_cases(spark):
    got = sharding.shard(documents(spark, HOSTILE, "string", CLASH)).collect()
    assert len(got) == len(HOSTILE) and len({r["shard"] for r in got if r["doc_id"] == "d1"}) == 1
    assert sharding.shard(documents(spark, [])).count() == 0
