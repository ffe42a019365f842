import base64
import hashlib

import public_tokenizers as P
import tiktoken

from citewright.llm import bpe
from citewright.llm.queries import TOKENIZER


def library():
    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_same_as_tiktoken_and_lossless(spark, docs, empty):
    extra = ["<|endoftext|> as text", "naïve 日本語 🙂🙂 é", "  two   spaces \n\n x", "don't we'LL I'd", "  　 ٣٤ ½"]
    more = spark.createDataFrame([(1000 + k, t) for k, t in enumerate(extra)], "doc_id long, text string")
    every = docs.select("doc_id", "text").unionByName(more)
    own = library()
    want = {}
    for r in every.collect():
        ids = own.encode_ordinary(r["text"] or "")
        want[r["doc_id"]] = (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r["text"] or "").encode()).hexdigest())
    got = bpe.round_trip(every, TOKENIZER).collect()
    assert len(got) == every.count()
    assert all(tuple(r)[1:] == want[r["doc_id"]] for r in got)
    assert bpe.round_trip(empty, TOKENIZER).count() == 0


def test_offsets_and_split_characters(spark):
    text = "héllo 🙂 wörld"
    table = spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string")
    encoded = bpe.encode(table, TOKENIZER)
    rows = {r["doc_id"]: r for r in encoded.collect()}
    assert rows[2]["ids"] == []
    r = rows[1]
    assert "".join(dict.fromkeys(text[a:b] for a, b in zip(r["starts"], r["ends"]))).replace(" ", "") == text.replace(" ", "")
    back = {x["doc_id"]: x for x in bpe.decode(encoded, TOKENIZER).collect()}
    assert back[1]["text"] == text and bytes(back[1]["bytes"]) == text.encode() and back[2]["text"] == ""
    codec = bpe.Codec(TOKENIZER)
    assert any(codec.decode([i]).decode("utf-8", "replace") == "�" or b"\xf0" in codec.decode([i]) for i in r["ids"])
