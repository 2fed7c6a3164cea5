import math
import random
from collections import Counter, defaultdict

import pyarrow as pa
from common_cases import CLASH, HOSTILE, documents
from pyspark.sql import functions as F

from loomql.llm import langid

WORDS = {"en": "the of and to in that was his with for not are".split(), "fr": "le de la et les des une que est dans pour été".split(), "de": "der die und das nicht ein mit sich für über wird".split()}


def corpus(rng, n=150):
    out = []
    for i in range(n):
        lang = rng.choice(list(WORDS))
        out.append((i, " ".join(rng.choices(WORDS[lang], k=rng.choice([2, 6, 30]))), lang, f"{lang if rng.random() < 0.8 else 'en'}{rng.randint(0, 2)}"))
    return out


def brute(rows, rows_to_read):
    """The same fusion with dictionaries, one row at a time."""
    names = sorted({r[2] for r in rows})

    def grams(t):
        b = b" " + bytes(c if 97 <= c <= 122 or c >= 128 else 32 for c in t.lower().encode()) + b"  "
        return [((b[i] << 16 | b[i + 1] << 8 | b[i + 2]) * 2654435769 % 2**32) >> 17 for i in range(len(b) - 2) if b[i + 1] != 32]

    counts = {k: Counter() for k in names}
    for _, t, lang, _ in rows:
        counts[lang].update(grams(t))
    order = sorted(names)
    B = langid.BUCKETS
    logp = lambda k, g: math.log((counts[k][g] + 0.5) / (sum(counts[k].values()) + 0.5 * B))
    text = lambda t: [sum(logp(k, g) for g in grams(t)) / 3 for k in order] + [len(grams(t)) * -math.log(B) / 3]
    best = lambda t: max(range(len(order) + 1), key=lambda i: text(t)[i]) if grams(t) else len(order)
    n = len(order)
    seen, base, host = [[1.0] * n for _ in range(n + 1)], [1.0] * n, defaultdict(lambda: [0] * n)
    for _, t, d, h in rows_to_read:
        if t and (b := best(t)) < n:
            base[b] += 1
            if h:
                host[h][b] += 1
            if d:
                seen[order.index(d) if d in order else n][b] += 1
    share = [x / sum(base) for x in base]
    out = {}
    for i, t, d, h in rows_to_read:
        t = t or ""
        log = text(t)
        c = host.get(h)
        for k in range(n):
            if c is not None:  # a source is its own domain: smoothed twice
                domain = (c[k] + langid.STRENGTH * share[k]) / (sum(c) + langid.STRENGTH)
                log[k] += math.log((c[k] + langid.STRENGTH * domain) / (sum(c) + langid.STRENGTH))
            else:
                log[k] += math.log(share[k])
            if d:
                row = order.index(d) if d in order else n
                log[k] += math.log(seen[row][k] / sum(seen[j][k] for j in range(n + 1)))
        log[n] += math.log(0.01) - (math.log(n + 1) if d else 0)
        if not grams(t):
            log[n] = -math.inf
        top = max(log)
        post = 1 / sum(math.exp(x - top) for x in log)
        b = log.index(top)
        out[i] = ((order + ["und"])[b], round(post, 5), b < n and post >= langid.LEAST and bool(grams(t)))
    return out


def test_against_brute_force(spark):
    rng = random.Random(6)
    rows = corpus(rng)
    wrong = [(1000, "der die das", "xx", "de1"), (1001, "le de", None, None), (1002, "zzqx vvkw", "en", "en0"), (1003, "", "fr", "fr0"), (1004, "le la les été", "en", "nowhere"), (1005, "12 34", "de", "de0")]
    kinds = "doc_id long, text string, lang string, source string"
    labelled, docs = spark.createDataFrame(rows, kinds), spark.createDataFrame(rows + wrong, kinds)
    model = langid.fit(docs, labelled, F.col("text"), declared=F.col("lang"), host=F.col("source"))
    got = {r["doc_id"]: (r["language"], round(r["posterior"], 5), r["accepted"]) for r in langid.identify(docs, model, F.col("text"), declared=F.col("lang"), host=F.col("source")).collect()}
    want = brute(rows, rows + wrong)
    assert got.keys() == want.keys()
    for i in got:
        assert got[i][0] == want[i][0] and abs(got[i][1] - want[i][1]) < 2e-5 and got[i][2] == want[i][2], (i, got[i], want[i])
    kept = {r["doc_id"] for r in langid.keep(docs, model, declared=F.col("lang"), host=F.col("source")).collect()}
    assert kept == {i for i, w in want.items() if w[2]} and 1003 not in kept and 1005 not in kept


def test_addresses(spark):
    rows = [("https://a.b.example.de:80/x", "de", "example.de", "a.b.example.de"), ("http://Host.Example.COM", "com", "example.com", "host.example.com"), ("nonsense", None, None, None), (None, None, None, None), ("http://localhost/x", None, "localhost", "localhost")]
    df = spark.createDataFrame([(u,) for u, *_ in rows], "u string")
    assert [tuple(r) for r in df.select(*langid.parts_of(None, F.col("u"))).collect()] == [tuple(r[1:]) for r in rows]


def test_held_out_pages_and_documents(spark):
    """Read by text alone, with no declaration and no host."""
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    train, held = docs.where("doc_id % 2 = 0"), docs.where("doc_id % 2 = 1 and n_chars > 60")
    model = langid.fit(held, train, F.col("text"))
    got = {r["doc_id"]: r["language"] for r in langid.identify(held, model, F.col("text")).collect()}
    want = {r["doc_id"]: r["lang"] for r in held.collect()}
    assert sum(got[i] == want[i] for i in want) / len(want) > 0.97


def test_cases(spark):
    docs = documents(spark, HOSTILE, "string", CLASH)
    model = langid.fit(docs, docs, F.col("text"), declared=F.col("lang"), host=F.col("source"))
    got = langid.identify(docs, model, F.col("text"), declared=F.col("lang"), host=F.col("source")).collect()
    assert len(got) == len(HOSTILE) and not any(r["accepted"] for r in got if r["doc_id"] in ("d2", "d3", "d4", "d5"))
    kept = langid.keep(docs, model, declared=F.col("lang"), host=F.col("source"))
    assert kept.columns == docs.columns and sum(r["doc_id"] == "d1" for r in kept.collect()) == 3
    none = documents(spark, [])
    model = langid.fit(none, none, F.col("text"), declared=F.col("lang"), host=F.col("source"))
    assert langid.identify(none, model, F.col("text"), declared=F.col("lang")).count() == 0
    assert langid.identify(docs, model, F.col("text")).where("language != 'und' or accepted").count() == 0


def test_slices_do_not_matter(monkeypatch):
    texts = pa.array(["some text", None, "", "été " * 500, "x"] * 9)
    table = langid.np.log(langid.np.random.default_rng(1).random((langid.BUCKETS, 3)))
    a, n = langid.text_evidence(table, texts)
    monkeypatch.setattr(langid, "SLICE", 100)
    b, m = langid.text_evidence(table, texts)
    assert langid.np.allclose(a, b) and (n == m).all()
