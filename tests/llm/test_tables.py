"""Operators on ids, vectors, turns and formats, and the pipeline, against brute force."""

import json
import math
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from paceline.llm import pieces, pseudonyms, quality, sharding, toolcalls, topk
from paceline.llm.words import Words, range_hashes

from . import brute

# -- sharding --------------------------------------------------------------

def test_jump_shards(spark):
    rows = [(i, "t" * (i % 5)) for i in range(-30, 400)] + [(None, None), (5, "t"), (5, "t"), (7, "é"), (1 << 62, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("shard", F.lit("x"))
    out = sharding.assign_shards(df, 7, slices=5).collect()
    assert len(out) == len(rows)
    for r in out:
        assert (r.shard, r.grown_shard) == (brute.jump(r.doc_id or 0, 7), brute.jump(r.doc_id or 0, 8))
        assert r.grown_shard in (r.shard, 7) and r.law == "key"
    want = sorted((i or 0, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in rows)
    assert sorted((r.doc_id or 0, r["size"], r.text_crc32) for r in out) == want
    for shard in range(7):
        own = [r for r in out if r.shard == shard]
        assert sorted(r.slot for r in own) == list(range(len(own)))
        ids = [r.doc_id for r in sorted(own, key=lambda r: r.slot) if r.doc_id is not None]
        assert ids == sorted(ids)
    assert sharding.assign_shards(df.limit(0), 7).count() == 0


# -- top k -----------------------------------------------------------------

@pytest.mark.parametrize("block", [4096, 7])
def test_topk(spark, block):
    rng = np.random.default_rng(2)
    rows = [(i, (rng.normal(size=6) * rng.choice([0.1, 1, 3])).tolist()) for i in range(120)]
    rows += [(200 + i, rows[3][1]) for i in range(12)] + [(10, rows[0][1]), (300, None), (301, [1.0, None]), (302, [float("nan")]),
             (303, [float("inf")] * 6), (None, [1.0] * 6), (310, []), (320, [0.5, -0.5]), (330, [0.0] * 6)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"norm": F.lit("x"), "part": F.lit(1)})
    out = topk.top_inner_products(df, F.col("vec_id") % 10 == 0, 5, block=block, query_block=4).collect()
    good = [(i, [math.floor(256 * x) for x in v] + [0] * (6 - len(v))) for i, v in rows
            if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    want = []
    for i, q in good:
        if i % 10 == 0:
            best = sorted((-sum(a * b for a, b in zip(q, v, strict=True)), j) for j, v in good if j != i)[:5]
            want += [(i, rank, j, -s) for rank, (s, j) in enumerate(best, 1)]
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in out) == sorted(want)
    assert topk.top_inner_products(df.limit(0), F.lit(True)).count() == 0
    one = topk.top_inner_products(df.filter("vec_id IN (1, 2)"), F.lit(True)).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id) for r in one) == [(1, 1, 2), (2, 1, 1)]


@pytest.mark.parametrize("size", [1e6, 3e6])
def test_topk_of_extreme_vectors(spark, size):
    rng = np.random.default_rng(4)
    rows = [(i, (rng.normal(size=4) * (size if i % 3 else 1)).tolist()) for i in range(40)] + [(50, [-size, size, 0.5, 0.0]), (51, [size, -size, 0.5, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    out = topk.top_inner_products(df, F.col("vec_id") % 10 == 0, 5, block=7).collect()
    whole, want = [(i, [math.floor(256 * x) for x in v]) for i, v in rows], []
    for i, q in whole:
        if i % 10 == 0:
            best = sorted((-sum(a * b for a, b in zip(q, v, strict=True)), j) for j, v in whole if j != i)[:5]
            want += [(i, rank, j, -s) for rank, (s, j) in enumerate(best, 1)]
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in out) == sorted(want)
    wide = spark.createDataFrame([(0, [size] * 4), (1, [1e9] * 4)], "vec_id long, embedding array<double>")
    with pytest.raises(ValueError, match="too long"):
        topk.top_inner_products(wide.union(wide.filter("vec_id = 1").withColumn("vec_id", F.lit(10))), F.col("vec_id") % 10 == 0)


# -- tool calls ------------------------------------------------------------

CALLS = "conv_id long, seq long, call_id string, parent_id string, name string, arguments string, level string"
RESULTS = "conv_id long, seq long, call_id string, content string"
TOOL = {"get": {"properties": {"n": {"type": "integer", "minimum": 0, "maximum": 9}, "s": {"type": "string", "enum": ["a", "b"]}},
                "required": ["n"], "additionalProperties": False}}


def test_tool_calls(spark):
    calls = [(1, 9, "a", None, "get", '{"s": "a", "n": 1}', "x"), (1, 2, "b", "a", "get", '{"n": 12, "z": 1}', "x"),
             (1, 1, "c", "b", "get", "[1]", "x"), (1, 4, "d", "e", "get", '{"n": 1}', "x"), (1, 5, "e", "d", "get", '{"n": true}', "x"),
             (1, 6, "f", "gone", "put", "{}", "x"), (1, 7, None, None, "get", "no json", "x"), (1, 7, "a", None, "get", "{}", "x"),
             (None, 1, "a", None, None, None, "x"), (2, 1, "a", "a", "get", '{"n": NaN}', "x"), (1, 8, "g", None, "get", '{"s": "q"}', "x")]
    calls += [(3, 1000 - i, f"k{i}", f"k{i - 1}" if i else None, "get", '{"n":2}', "x") for i in range(70)]
    results = [(1, 3, "a", "first"), (1, 4, "a", "second"), (1, 5, "lost", None), (1, 6, None, "nobody's"), (None, 2, "a", "é")]
    out = toolcalls.link_tool_calls(spark.createDataFrame(calls, CALLS), spark.createDataFrame(results, RESULTS), TOOL).collect()
    got = {(r.conv_id, r.call_id, r.seq): r for r in out}
    state = {k[1]: (r.status, r.level, r.errors) for k, r in got.items() if k[0] == 1}
    assert state["b"] == ("unanswered", 1, ["extra:z", "range:n"]) or state["b"] == ("unanswered", 1, ["range:n", "extra:z"])
    assert state["c"] == ("unanswered", 2, ["not_object"]) and state["f"] == ("unknown_parent", 0, ["unknown_tool"])
    assert state["d"] == ("ring", None, []) and state["e"] == ("ring", None, ["type:n"]) and state["lost"] == ("orphan", None, [])
    assert state["g"] == ("unanswered", 0, ["missing:n", "enum:s"])
    a = got[1, "a", 7]
    assert (a.status, a.n_results, a.errors) == ("linked", 2, ["missing:n"]) and json.loads(a.json)["result"] == "first"
    assert got[1, None, 7].errors == ["not_json"] and got[1, None, 6].status == "orphan"
    assert got[None, "a", 1].status == "linked" and '"result":"é"' in got[None, "a", 1].json
    assert got[2, "a", 1].status == "ring" and got[2, "a", 1].errors == ["not_json"]
    chain = sorted((r for r in out if r.conv_id == 3), key=lambda r: (r.level, r.seq))
    assert [r.call_id for r in chain] == [f"k{i}" for i in range(70)]
    assert all(r.json == toolcalls.canonical(json.loads(r.json)) for r in out) and len(out) == 10 + 70 + 2
    none = toolcalls.link_tool_calls(spark.createDataFrame([], CALLS), spark.createDataFrame([], RESULTS), TOOL)
    assert none.count() == 0


def test_arguments_that_are_no_json_or_odd_never_end_a_job(spark):
    inner = {"properties": {"a": {"type": ["integer", "null"]}, "b": {"type": "array", "items": {"type": "object", "properties": {
        "c": {"type": "string", "pattern": "^x"}}, "required": ["c"], "additionalProperties": False}, "maxItems": 2}, "n": {"exclusiveMinimum": 0}}}
    cases = {'{"n":1e400}': ["not_json"], '{"a":"\\ud800"}': ["not_json"], "NaN": ["not_json"], "[" * 100_000: ["not_json"], '{"a":null,"n":1}': [],
             '{"a":2.5}': ["type:a"], '{"a":1,"a":2}': ["repeated:a"], '{"b":[{"c":"x1"},{"c":"y"}]}': ["pattern:b[1].c"], '{"n":0}': ["range:n"],
             '{"b":[{},{"c":"x","d":1}]}': ["missing:b[0].c", "extra:b[1].d"], '{"b":[1,2,3]}': ["length:b"], '{"n":' + "9" * 5000 + "}": ["not_json"],
             '{"n":123456789012345678901234567890}': [], '"\\udc00\\ud800"': ["not_json"], "": ["not_json"], '{"n":true}': []}
    calls = [(i, 1, "a", None, "get", text, "x") for i, text in enumerate(cases)]
    out = toolcalls.link_tool_calls(spark.createDataFrame(calls, CALLS), spark.createDataFrame([], RESULTS), {"get": inner}).collect()
    assert {r.conv_id: r.errors for r in out} == dict(enumerate(cases.values()))
    assert all(json.loads(r.json)["valid"] == (not r.errors) for r in out)


def test_tool_call_sql_says_what_the_query_says_of_repeated_turns(spark, tmp_path):
    turns = [(1, 0, "user", "q"), (1, 1, "assistant", "hello"), (1, 1, "assistant", "a hello"), (1, 2, "user", "one"), (1, 2, "user", None),
             (1, 3, "assistant", "w " * 130), (1, 3, "assistant", ""), (2, 2, "user", "alone"), (2, 2, "user", "alone"), (2, 5, "assistant", None)]
    df = spark.createDataFrame(turns, "conv_id long, turn int, role string, text string")
    df.write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    want = con.execute(toolcalls.TOOL_CALLS_SQL)
    names = [c[0] for c in want.description]
    got = toolcalls.op6_tool_calls(spark, str(tmp_path)).select(*names).collect()
    assert sorted(map(tuple, got), key=str) == sorted(want.fetchall(), key=str) and len(got) == 8


def test_no_repeated_call_or_result_is_lost(spark):
    calls = [(1, 2, "a", None, "get", '{"n": 1}', "x"), (1, 4, "a", None, "get", '{"n": 12}', "x"), (1, 4, "a", None, "get", '{"n": 12}', "x"),
             (1, 5, None, None, "get", "{}", "x"), (1, 5, None, None, "get", "[]", "x"), (None, 1, "a", "b", "get", '{"n": 2}', "x")]
    results = [(1, 3, "a", "first"), (1, 6, "a", "second"), (1, 7, "a", None), (2, 1, "lost", "one"), (2, 2, "lost", "two")]
    made = spark.createDataFrame(calls, CALLS), spark.createDataFrame(results, RESULTS)
    out = toolcalls.link_tool_calls(*made, TOOL, every=True).collect()
    told = lambda status: sorted((r.conv_id or 0, r.seq, json.loads(r.json)["arguments"], json.loads(r.json)["result"], r.level)
                                 for r in out if r.status == status)
    assert told("linked") == [(1, 2, {"n": 1}, "first", 0)] and told("orphan") == [(2, 1, None, "one", None)]
    assert told("duplicate_call")[:2] == [(1, 4, {"n": 12}, None, None)] * 2 and len(told("duplicate_call")) == 3
    assert told("extra_result") == [(1, 6, None, "second", None), (1, 7, None, None, None), (2, 2, None, "two", None)]
    assert [r.errors for r in out if r.status == "duplicate_call" and r.call_id] == [["range:n"]] * 2
    assert len(out) == len(calls) + len(results) - 1
    assert len(toolcalls.link_tool_calls(*made, TOOL).collect()) == 4


def test_turns_as_calls(spark):
    turns = duckdb.sql("SELECT conv_id, turn, role, text FROM '/root/testdata/sf0.001/conversations.parquet'").fetchall()
    df = spark.createDataFrame([*turns, (-1, 1, "assistant", None), (-1, 2, "user", "")], "conv_id long, turn long, role string, text string")
    out = toolcalls.link_tool_calls(*toolcalls.calls_of_turns(df), toolcalls.SCHEMAS).collect()
    users = {(c, t): x for c, t, r, x in turns if r == "user"}
    asked = {(c, t): x for c, t, r, x in turns if r == "assistant"}
    seen = [r for r in out if r.conv_id >= 0 and r.name]
    assert {(r.conv_id, r.seq) for r in seen} == set(asked)
    for r in seen:
        level, at = 0, r.seq
        while at > 1 and (r.conv_id, at - 2) in asked:
            level, at = level + 1, at - 2
        line = json.loads(r.json)
        assert r.level == level and line["result"] == users.get((r.conv_id, r.seq + 1))
        assert line["arguments"]["text"] == asked[r.conv_id, r.seq]


# -- pseudonyms ------------------------------------------------------------

def _apply(spark, texts, key="k"):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumns({"found": F.lit(1), "hits": F.lit(2)})
    return pseudonyms.pseudonymise(df, key).orderBy("doc_id").collect()


def _luhn(s):
    twice = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(s))]
    return sum(x - 9 * (x > 9) for x in twice) % 10 == 0


def test_pseudonyms_keep_formats_and_links(spark):
    texts = ["card 4111111111111111, again 4111111111111111 bad 4111111111111112", "x 4111111111111111", None, "", "none", "é +1 (017) 555-7713 é",
             "10.0.0.1 999.1.1.1 01.2.3.4 1.2.3", "2020-02-29 2021-02-29 29.02.2020 29/02/2020", "123-45-6789 000-45-6789 666-45-6789",
             "mail Ab.9@mail7.example.com", "1 " * 3000 + "10.0.0.1"]
    out = _apply(spark, texts)
    first = out[0].found[0].pseudonym
    assert [f.pseudonym for f in out[0].found] == [first] * 2 == [f.pseudonym for f in out[1].found] * 2
    assert first != "4111111111111111" and _luhn(first) and len(first) == 16 and out[0].text.endswith("bad 4111111111111112")
    assert [out[i].text for i in (2, 3, 4)] == [None, "", "none"] and out[2].found == []
    assert re.fullmatch(r"é \+1 \(\d{3}\) \d{3}-\d{4} é", out[5].text)
    assert [f.kind for f in out[6].found] == ["ip"] and out[6].text.endswith(" 999.1.1.1 01.2.3.4 1.2.3")
    iso, dotted, slashed = (f.pseudonym for f in out[7].found)
    assert dotted.split(".")[::-1] == iso.split("-") == slashed.split("/")[::-1] and " 2021-02-29 " in out[7].text
    assert [f.kind for f in out[8].found] == ["ssn"] and re.fullmatch(r"[A-Z][a-z]\.\d@mail7.example.com", out[9].found[0].pseudonym)
    assert out[10].found[0].pseudonym == out[6].found[0].pseudonym and out[10].text.startswith("1 " * 3000)
    for text, r in zip(texts, out, strict=True):
        for f in r.found:
            assert len(text[f.start : f.stop]) > 0 and f.pseudonym in r.text
    assert _apply(spark, texts[:1], "other")[0].text != out[0].text
    assert pseudonyms.pseudonymise(spark.createDataFrame([], "doc_id long, text string"), "k").count() == 0


def test_cards_in_groups_and_national_phones(spark):
    texts = ["4111111111111111", "a 4111 1111 1111 1111, 4111-1111-1111-1111.", "3782 822463 10005 and 3056-930902-5904", "4111 1111 1111 1111 123",
             "(555) 123-4567 555-123-4567 1-555-123-4567 555.123.4567", "4111 1111 1111 1112 4111-1111 1111-1111",
             "4111 1111 1111 1111 10.0.0.1 4111 1111 1111 2020-02-29 1-4111-1111-1111-1111", "id-555-123-4567 555-123-4567-8 12555-123-4567"]
    out = _apply(spark, texts)
    kinds = [[f.kind for f in r.found] for r in out]
    assert kinds == [["card"], ["card"] * 2, ["card"] * 2, ["card"], ["phone"] * 4, [], ["card", "ip", "iso_date"], ["phone"]]  # "id-" before a number is no reason to leave it
    plain = out[0].text
    grouped = lambda s: s.join(plain[i : i + 4] for i in range(0, 16, 4))
    assert out[1].text == f"a {grouped(' ')}, {grouped('-')}." and out[3].text == f"{grouped(' ')} 123" and plain != texts[0]
    assert re.fullmatch(r"\d{4} \d{6} \d{5} and \d{4}-\d{6}-\d{4}", out[2].text) and out[2].text != texts[2]
    assert all(_luhn(re.sub("[ -]", "", f.pseudonym)) for r in out for f in r.found if f.kind == "card")
    assert re.fullmatch(r"\(\d{3}\) \d{3}-\d{4} \d{3}-\d{3}-\d{4} \d-\d{3}-\d{3}-\d{4} \d{3}\.\d{3}\.\d{4}", out[4].text)
    for text, r in zip(texts, out, strict=True):
        assert all(text[f.start : f.stop] != f.pseudonym == r.text[f.start : f.stop] for f in r.found if f.kind in ("card", "phone"))


def test_permutations_are_bijections(spark):
    n = spark.range(30 * 7).select("id", pseudonyms.permute_number(F.col("id"), 30, 7, "k", "x").alias("to"))
    assert sorted(r.to for r in n.collect()) == list(range(210))
    codes = spark.range(2600).select(F.concat(F.chr(97 + F.col("id") % 26), F.lpad((F.col("id") / 26).cast("int").cast("string"), 2, "0")).alias("v"))
    assert codes.select(pseudonyms.permute_text(F.col("v"), "k", "x")).distinct().count() == 2600
    days = spark.range(5000).select(F.date_add(F.lit("1990-01-01").cast("date"), F.col("id").cast("int")).cast("string").alias("text"), F.col("id").alias("doc_id"))
    moved = {r.text for r in pseudonyms.pseudonymise(days, "k").collect()}
    assert len(moved) == 5000 and all(re.fullmatch(r"(1[89]|2[01])\d\d-\d\d-\d\d", d) for d in moved)


def test_pseudonyms_equal_plain_python(spark):
    values = [("email", "jan.Novak+1@mail.cz"), ("email", "x@a.b"), ("phone", "+420 777 123 456"), ("phone", "+1-555-123-4567"), ("phone", "(555) 123-4567"),
              ("phone", "555.123.4567"), ("ip", "10.0.0.255"), ("ip", "0.0.0.0"), ("ip", "255.255.255.255"), ("iso_date", "1800-01-01"), ("iso_date", "2199-12-31"),
              ("iso_date", "2020-02-29"), ("day_date", "01.02.2020"), ("day_date", "1/2/1999"), ("ssn", "001-01-0001"), ("ssn", "899-99-9999"),
              ("ssn", "665-10-1234"), ("ssn", "667-10-1234"), ("card", "4111111111111111"), ("card", "4111 1111 1111 1111"), ("card", "3782-822463-10005")]
    df = spark.createDataFrame([(i, k, v) for i, (k, v) in enumerate(values)], "i int, kind string, v string")
    for key in ("k", "another key"):
        out = df.select("i", pseudonyms.kind_of(F.col("v")).alias("seen"), pseudonyms.pseudonym(F.col("v"), F.col("kind"), key).alias("to")).orderBy("i").collect()
        assert [r.seen for r in out] == [k for k, _ in values]
        assert [r.to for r in out] == [brute.pseudonym(v, k, key) for k, v in values]


# -- SentencePiece ---------------------------------------------------------

TEXTS = [None, "", " ", "  a  b ", "\n", "a\n\nb", "x\ty\r\n", "▁", "a▁b", "<s> <0x0A>", "日本語 \U0001f600 é", "a" * 50, "\n\n a", "word " * 3000]


def unigram_model() -> bytes:
    from sentencepiece import sentencepiece_model_pb2 as pb

    m = pb.ModelProto()
    for piece, score, kind in [("<unk>", 0, 2), ("<s>", 0, 3), *[(f"<0x{b:02X}>", 0, 6) for b in range(256)], ("▁", -3, 1), ("a", -2.5, 1),
                               ("b", -2.7, 1), ("ab", -3.1, 1), ("▁a", -3.3, 1), ("ba", -4.5, 1), ("▁abba", -6.1, 1)]:
        p = m.pieces.add()
        p.piece, p.score, p.type = piece, score, kind
    m.trainer_spec.model_type, m.trainer_spec.byte_fallback = 1, True
    m.normalizer_spec.add_dummy_prefix = m.normalizer_spec.escape_whitespaces = True
    m.normalizer_spec.remove_extra_whitespaces = False
    return m.SerializeToString()


def test_memo_hits_are_compared_byte_by_byte(monkeypatch):
    """With a hash of eight values nearly every stretch meets another one's entry."""
    import sentencepiece

    monkeypatch.setattr(pieces, "range_hashes", lambda *a: range_hashes(*a) % np.uint64(8))
    data = pieces.load_model(pieces.MODEL_PATH)
    texts = ["the quick brown fox jumps over the lazy dog", "a b c d e f g\nh i j", None, "", "dog lazy the", " the  fox"] * 2
    ids, back, same = pieces.Codec(data).run(texts)
    own = sentencepiece.SentencePieceProcessor(model_proto=data)
    assert [i.tolist() for i in ids] == [own.encode(t or "") for t in texts] and all(same)


@pytest.mark.parametrize("data", [pieces.load_model(pieces.MODEL_PATH), unigram_model()], ids=["bpe", "unigram"])
def test_pieces_equal_the_own_library(spark, data):
    import sentencepiece

    own = sentencepiece.SentencePieceProcessor(model_proto=data)
    texts = [*TEXTS, "abba ab baab", *(r[0] for r in duckdb.sql("SELECT text FROM '/root/testdata/sf0.001/documents.parquet' LIMIT 60").fetchall())]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumns({"ids": F.lit(1), "rest": F.lit(2)})
    out = pieces.encode_pieces(df, data).orderBy("doc_id").collect()
    assert [r.ids for r in out] == [own.encode(t or "") for t in texts]
    assert all(r.parity and r.round_trip or "<s>" in (r.text or "") for r in out) and out[0].rest == 2
    assert pieces.encode_pieces(df.limit(0), data).count() == 0


@pytest.mark.parametrize("data", [pieces.load_model(pieces.MODEL_PATH), unigram_model()], ids=["bpe", "unigram"])
def test_ids_are_the_rebuilt_tokenizers_own(spark, data):
    import sentencepiece

    texts = [*TEXTS, "<s>", "a <s>ab<0x41> b", "<unk> é<unk>", "q<s"]
    codec = pieces.Codec(data)
    codec.own = sentencepiece.SentencePieceProcessor(model_proto=data)
    ids, back, same = codec.run(texts)
    assert [i.tolist() for i in ids] == [codec.own.encode(t or "") for t in texts] and back.all() and same.all()

    class Other:
        def encode(self, texts, num_threads):
            return [[0] for _ in texts]

    codec = pieces.Codec(data)
    codec.own, codec.line = Other(), 0
    others, _, same = codec.run(texts)
    assert [i.tolist() for i in others] == [i.tolist() for i in ids] and not same[4:].any()


@pytest.mark.parametrize("data", [pieces.load_model(pieces.MODEL_PATH), unigram_model()], ids=["bpe", "unigram"])
def test_decoding_a_column(spark, data):
    import sentencepiece

    own = sentencepiece.SentencePieceProcessor(model_proto=data)
    texts = [t for t in TEXTS if t is not None]
    rows = [*enumerate(own.encode(t) for t in texts), (90, None), (91, [1, *own.encode("a b")] if own.is_control(1) else own.encode("a b"))]
    df = spark.createDataFrame(rows, "doc_id long, ids array<int>").withColumns({"text": F.lit("x"), "rest": F.lit(2)})
    out = {r.doc_id: r for r in pieces.decode_pieces(df, data).collect()}
    assert [out[i].text for i in range(len(texts))] == [own.decode(i) for _, i in rows[: len(texts)]]
    assert out[90].text is None and out[91].text == "a b" and out[0].rest == 2
    with pytest.raises(Exception, match="not one of the model"):
        pieces.decode_pieces(spark.createDataFrame([(1, [10**7])], "doc_id long, ids array<int>"), data).collect()
    assert pieces.decode_pieces(df.limit(0), data).count() == 0


def test_model_parsing():
    model = pieces.Model.parse(unigram_model())
    assert (model.kind, model.byte_fallback, model.unknown, model.trim_spaces) == (pieces.UNIGRAM, True, 0, False)
    assert len(model.pieces) == 265 and model.pieces[-1][0] == "▁abba" and math.isclose(model.pieces[-1][1], -6.1, rel_tol=1e-6)
    assert not model.splits() and pieces.Model.parse(pieces.load_model(pieces.MODEL_PATH)).splits()


# -- pipeline --------------------------------------------------------------

@pytest.mark.parametrize("labels", [[], [(-1, 1), (None, 0), (2, None)]], ids=["empty", "none joins"])
def test_nothing_learned_rejects_nothing(spark, tmp_path, labels):
    rows = [(1, "One short text.", 15), (2, "And another one!", 16), (3, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long").withColumn("source", F.lit("s"))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert sorted(r.doc_id for r in corpus_pipeline.good_quality(spark, docs, str(tmp_path)).collect()) == [1, 2, 3]
    assert sorted(r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()) == [1, 2, 3]


def test_pipeline_against_brute_force(spark, tmp_path):
    import sentencepiece

    d = "/root/testdata/sf0.001"
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{d}/documents.parquet' ORDER BY doc_id").fetchall()
    items = duckdb.sql(f"SELECT item_id, text FROM '{d}/benchmark.parquet'").fetchall()
    model = quality.fit_quality(spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet"), lambda i: F.lit(True))
    score = model.network.score(quality.pooled(Words([t for _, t in rows]), model.vectors))
    rows = [r for r, s in zip(rows, score.tolist(), strict=True) if s >= quality.KEEP]
    comp = brute.components(rows, 5)
    rows = [r for r in rows if comp[r[0]] == r[0]]
    clean = []
    for i, text in rows:
        w, hit, _ = brute.leaks(text, items)
        raw, spans, at = text.encode(), list(brute.PLAIN.finditer(text.encode().lower())), 0
        runs, k = [], 0
        while k < len(w):
            e = k
            while e < len(w) and hit[e]:
                e += 1
            if e - k >= 10:
                runs.append((k, e))
            k = max(e, k + 1)
        if sum(e - b for b, e in runs) > 0.5 * len(w):
            continue
        out = b""
        for b, e in runs:
            out, at = out + raw[at : spans[b].start()], spans[e - 1].end()
        text, at, masked = (out + raw[at:]).decode(), 0, ""
        for b, _, e, kind in brute.base_spans(text):
            if b >= at:
                masked += text[at:b] + f"<{kind}>"
            at = max(at, e)
        clean.append((i, masked + text[at:]))
    own = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL_PATH)
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, d).collect()}
    assert sorted(got) == [i for i, _ in clean]
    for i, text in clean:
        assert got[i].ids == own.encode(text) and got[i].parity and got[i].round_trip
