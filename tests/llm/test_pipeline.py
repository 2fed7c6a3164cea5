import random

import corpus_pipeline
from common_cases import CLASH, HOSTILE, documents
from pyspark.sql import functions as F
from test_simhash import close, words as word_set
from test_substring import words

from loomql.llm import tokens
from loomql.llm.common import staged

HEX = "9b0b3c6a43eb78aa99cbd7049c572391524f37a8"


def stages(spark, docs):
    out = {"documents": docs}
    for name, fn in corpus_pipeline.STAGES:
        docs = staged(fn(spark, docs, ""), f"test-{name}")
        out[name] = docs
    return out


def test_against_brute_force(spark, tmp_path):
    """Distinct documents with one planted case each; what run() gives is what
    plain Python makes of them."""
    rng = random.Random(11)
    text = {i: " ".join(words(rng, 150)) for i in range(40)}
    passage = " ".join(words(rng, 70))
    for i in (3, 4, 5):
        half = text[i].split()
        text[i] = " ".join([*half[:75], passage, *half[75:]])
    text[6] += f' token = "{HEX}"'
    text[40] = text[10]
    text[41] = text[11].replace(text[11].split()[7], "changed", 1)
    text[42], text[43], text[44] = "", None, "1234 5678"
    docs = documents(spark, list(text.items()))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = stages(spark, docs)
    by = lambda name: {r["doc_id"]: r["text"] for r in got[name].collect()}
    assert by("language_id") == {i: t for i, t in text.items() if i < 42}
    near = by("simhash_near_dedup")
    assert near == {i: t for i, t in text.items() if i < 40}
    assert all(not close(word_set(a), word_set(b)) for i, a in near.items() for j, b in near.items() if i < j)
    cut = by("substring_dedup")
    whole = [i for i in (3, 4, 5) if passage in cut[i]]
    assert len(whole) == 1 and all(" ".join(cut[i].split()) == " ".join(text[i].replace(passage, "").split()) for i in {3, 4, 5} - {*whole})
    assert {i: t for i, t in cut.items() if i not in (3, 4, 5)} == {i: t for i, t in near.items() if i not in (3, 4, 5)}
    clean = by("secret_scan")
    assert clean == {i: t.replace(HEX, "[REDACTED]") for i, t in cut.items()}
    count = tokens.counter(tokens.FOLDER).count
    final = corpus_pipeline.run(spark, str(tmp_path)).collect()
    sums = {}
    for r in final:
        sums[r["doc_id"]] = sums.get(r["doc_id"], 0) + r["n_tokens"]
    assert sums == {i: count(t) for i, t in clean.items()}
    assert final[0].__fields__ == ["doc_id", "chunk", "n_tokens", "sequence_id", "first_token"]


def test_cases(spark):
    for kind in ("long", "string"):
        got = stages(spark, documents(spark, HOSTILE, kind, CLASH))
        names = [n for n, _ in corpus_pipeline.STAGES]
        assert all(got[n].columns == got["documents"].columns for n in names[:-1])
        kept = {str(r["doc_id"]).lstrip("d") for r in got["language_id"].select("doc_id").collect()}
        assert not kept & {"2", "3", "4", "5"} and {"1", "None", "6", str(2**60 + 1)} <= kept
        assert got["simhash_near_dedup"].where(F.col("doc_id").cast("string").isin("1", "d1")).count() == 1
    assert stages(spark, documents(spark, []))["packing"].count() == 0
