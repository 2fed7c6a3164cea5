import __spark_entry__
from loomql.llm import pieces, tokens

SF = "/root/testdata/sf0.001"


def test_registered_over_whole_tables(spark):
    found = __spark_entry__.queries()
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert {"op1_packing", "op4_pieces", "op6_sharding", "op7_tokens", "op9_simhash"} <= set(found)

    encoding = tokens.counter(tokens.FOLDER).encoding
    want = {i: len(encoding.encode_ordinary(t)) for i, t in text.items()}
    assert {r["doc_id"]: r["n_tokens"] for r in found["op7_tokens"](spark, SF).collect()} == want

    packed = found["op1_packing"](spark, SF).collect()
    sums, spans = {}, {}
    for r in packed:
        sums[r["doc_id"]] = sums.get(r["doc_id"], 0) + r["n_tokens"]
        spans.setdefault(r["sequence_id"], []).append((r["first_token"], r["first_token"] + r["n_tokens"]))
    assert sums == {i: n for i, n in want.items() if n}
    for span in spans.values():
        span.sort()
        assert span[0][0] == 0 and span[-1][1] <= 4096 and all(a[1] == b[0] for a, b in zip(span, span[1:]))

    encoded = found["op4_pieces"](spark, SF)
    assert {r["doc_id"]: r["text"] for r in pieces.decode(encoded).collect()} == text

    placed = found["op6_sharding"](spark, SF).collect()
    assert sorted(r["doc_id"] for r in placed) == sorted(text)
    shard = {}
    for r in placed:
        assert 0 <= r["shard"] < 64 and shard.setdefault(text[r["doc_id"]], r["shard"]) == r["shard"]
