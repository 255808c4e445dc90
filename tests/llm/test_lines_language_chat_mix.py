import json
import random
import re

import pytest
from pyspark.sql import functions as F

from feedelta.llm import chat, language, line_dedup, mixing


def test_lines(spark):
    rows = [(i, f"own {i}\n common \n\nrare", f"s{i % 6}") for i in range(12)] + [(50, None, "s0"), (51, "", None), (52, "common", "s1"), (None, "common\nnull id", "s2")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, source string, n_lines int")
    got = {r.doc_id: r for r in line_dedup.dedup(df, min_sites=6).collect()}
    assert got[0].text == "own 0\n common \n\nrare" and got[0].n_removed == 0
    assert got[5].text == "own 5\n" and got[5].n_removed == 2 and got[5].n_lines == 4
    assert got[50].text is None and got[51].text == "" and got[52].text == "" and got[None].text == "null id"
    assert line_dedup.dedup(df, min_sites=7).where("n_removed > 0").count() == 0
    assert line_dedup.dedup(df.where("false")).count() == 0


def test_spread_is_exact_near_the_threshold_and_above(spark):
    many = spark.range(3000).select(F.explode(F.array(*[F.struct(F.lit(k).cast("long").alias("h1"), F.lit(0).cast("long").alias("h2"), F.concat(F.lit("s"), F.col("id") % m).alias("site")) for k, m in ((1, 9), (2, 10), (3, 11), (4, 2000))])))
    got = {r.h1 for r in line_dedup.spread(many.select("col.*"), 10).collect()}
    assert got == {2, 3, 4}


def phrases(text, sample):
    n = i = 0
    while i < len(text):
        k = 1
        while i + k <= len(text) and text[i : i + k] in sample:
            k += 1
        i += max(1, k - 1)
        n += 1
    return n


def test_phrase_counts_are_those_of_greedy_parsing():
    samples = {"a": "the cat sat on the mat and the rat", "b": "le chat est sur la table avec le rat"}
    parser = language.Parser(language.Model(samples, {"a": 2, "b": 1}))
    texts = ["The cat, the RAT!", "le chat sur", "q", "", None, "  mat  ", "12 34", "zzz the"]
    got, n = parser.counts(texts)
    for t, row, k in zip(texts, got.tolist(), n.tolist(), strict=True):
        plain = language.letters(t or "")
        assert k == len(plain.replace(" ", ""))
        assert row == [phrases(plain, s) for s in samples.values()]
    lang, score, *_ = parser.predict(texts)
    assert lang[:2] == ["a", "b"] and lang[3:5] == ["und", "und"] and lang[6] == "und"
    assert all(0 <= s <= 1 for s in score)


@pytest.mark.parametrize("block", [3, 16, 256])
def test_long_texts_have_no_borders(block, monkeypatch):
    monkeypatch.setattr(language, "BLOCK", block)
    rng = random.Random(block)
    make = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    samples = {"a": language.letters(make("abcd ", 3000)), "b": language.letters(make("abce ", 3000))}
    parser = language.Parser(language.Model(samples, {"a": 2, "b": 1}))
    # Whole passages of a sample are single phrases over many blocks; unknown letters stand between them.
    texts = [make("abcde  ,", 4000), samples["a"][100:2500], samples["a"][7:1500] + "zz" + samples["b"][3:2000], "z" * 700, "a", make("abcd ", 257), samples["b"] + samples["b"], " " * 600 + "ab"]
    got, _ = parser.counts(texts)
    assert got.tolist() == [[phrases(language.letters(t), s) for s in samples.values()] for t in texts]


def test_held_out_accuracy(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language.identify(d).join(d.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in got) >= 0.97 * len(got) > 0


def test_unlearned_languages_are_foreign(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language.train(d)
    rng = random.Random(5)
    syllables = ["kwo", "zhu", "pfi", "ngy", "xam", "juo", "vyk", "bwe"]
    strange = [" ".join("".join(rng.choice(syllables) for _ in range(rng.randrange(2, 5))) for _ in range(200))]
    polish = ["Litwo ojczyzno moja ty jestes jak zdrowie ile cie trzeba cenic ten tylko sie dowie kto cie stracil dzis pieknosc twa w calej ozdobie widze i opisuje bo tesknie po tobie"]
    new = spark.createDataFrame([(i, t) for i, t in enumerate(strange + polish * 4)], "doc_id long, text string")
    assert all(r.foreign for r in language.predict(new.where("doc_id = 0"), model).collect())
    assert all(r.foreign for r in language.predict(new.where("doc_id > 0").groupBy().agg(F.concat_ws(" ", F.collect_list("text")).alias("text")), model).collect())
    # What is labelled with a learned language is left alone.
    assert language.predict(d.where("lang IS NOT NULL"), model).where("foreign").count() == 0


def test_language_edge_cases(docs, no_docs):
    got = {r.doc_id: r for r in language.identify(docs).collect()}
    assert got[3].lang_pred == got[4].lang_pred == got[5].lang_pred == "und" and got[3].score == 0
    assert language.identify(no_docs).count() == 0
    assert {r.lang_pred for r in language.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_language_with_long_texts_only(spark):
    words = {"aa": "ka lo mi tu re sa", "bb": "xen pyr qof wuz jik vam"}
    rows = []
    for lang, w in words.items():
        for i in range(8):
            rows.append((len(rows), (w + f" {w[i]}{w[-1 - i]} ") * (10 if lang == "aa" else 2500), lang))
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.train(d)
    assert min(len(t) for _, t, k in rows if k == "bb") > language.LONGEST and sorted(model.langs) == ["aa", "bb"]
    assert max(2**b for b in model.bits) <= language.TRAIN_CHARS + 1
    got = {r.doc_id: r.lang_pred for r in language.identify(d).collect()}
    assert all(got[i] == k for i, _, k in rows)
    late = d.withColumn("text", F.concat(F.lit("7 " * 30_000), "text"))  # letters come late
    assert sorted(language.train(late).langs) == ["aa", "bb"]


TOOLS = {"add": {"a": ("number", True), "b": ("integer", True), "note": ("string", False)}, "now": {}}


def call(i, name, args):
    return {"id": i, "name": name, "arguments": args}


def test_tool_calls(spark):
    js = lambda x: json.dumps(x)
    rows = [
        (1, 0, "user", 'say "hi"\n'),
        (1, 1, "tool", js({"tool_call_id": "c1", "content": "3"})),  # before its call
        (1, 2, "assistant", js({"content": "ok", "tool_calls": [call("c1", "add", {"b": 2, "a": 1.5}), call("c2", "add", {"b": 1.5, "a": 1}), call("c3", "now", {}), call(None, "now", {})]})),
        (1, 3, "tool", js({"tool_call_id": "c3", "content": None})),
        (1, 4, "tool", js({"tool_call_id": "zz", "content": "?"})),
        (2, 0, "assistant", js({"tool_calls": [call("c1", "add", {"a": 1, "b": 2, "c": 3}), call("c4", "nope", {})]})),
        (None, None, None, None),
        (None, 1, "tool", js({"tool_call_id": "c1"})),
        (3, 0, "assistant", js({"a": 1})),
        (3, 0, "assistant", "[1"),
        (3, 0, "assistant", "[1"),
    ]
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, position int")
    got = chat.format_chats(df, chat.tool_schemas(spark, TOOLS)).collect()
    assert len(got) == len(rows)
    one = sorted((r for r in got if r.conv_id == 1), key=lambda r: r.position)
    assert [r.position for r in one] == [0, 1, 2, 3, 4]
    assert [r.turn for r in one] == [0, 2, 1, 3, 4]
    assert [r.link for r in one] == [None, None, "linked", "linked", "orphan"]
    calls = one[1]
    assert (calls.n_calls, calls.n_valid, calls.n_unanswered) == (4, 2, 2)
    assert json.loads(one[0].message) == {"content": 'say "hi"\n', "role": "user"}
    assert '{"arguments":{"a":1.5,"b":2},"id":"c1","name":"add","valid":true}' in calls.message
    for r in got:
        assert json.dumps(json.loads(r.message), ensure_ascii=False, separators=(",", ":")) == r.message
    two = next(r for r in got if r.conv_id == 2)
    assert (two.n_calls, two.n_valid, two.n_unanswered) == (2, 0, 2)
    assert all(r.link in (None, "orphan") for r in got if r.conv_id is None)
    assert chat.format_chats(df.where("false")).count() == 0


def test_chains_of_waiting_messages(spark):
    js = lambda x: json.dumps(x)
    wait = lambda i, *after: js({"tool_calls": [{"id": i, "name": "now", "arguments": {}, "after": list(after)}]})
    rows = [
        (1, 1, "assistant", wait("a")),
        (1, 2, "assistant", wait("b", "a", "nope")),
        (1, 3, "assistant", wait("c", "b", "d")),  # d is called later, so nothing waits for it
        (1, 4, "tool", js({"tool_call_id": "c"})),
        (1, 5, "tool", js({"tool_call_id": "b"})),
        (1, 6, "user", "x"),
        (1, 7, "assistant", wait("d")),
        (1, 9, "tool", js({"tool_call_id": "a", "tool_calls": [{"id": "e", "name": "now", "arguments": {}}]})),
        (1, 9, "user", "later"),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = sorted(chat.format_chats(df, chat.tool_schemas(spark, TOOLS)).collect(), key=lambda r: r.position)
    assert [(r.turn, r.role) for r in got] == [(1, "assistant"), (6, "user"), (7, "assistant"), (9, "tool"), (9, "user"), (2, "assistant"), (5, "tool"), (3, "assistant"), (4, "tool")] or [(r.turn, r.role) for r in got][3:5] == [(9, "user"), (9, "tool")]
    assert [r.position for r in got] == list(range(9)) and sum(r.n_calls for r in got) == 4
    assert [r.turn for r in got][-4:] == [2, 5, 3, 4]


def test_many_rows_of_one_turn(spark):
    rows = spark.range(3000).selectExpr("1L AS conv_id", "CASE WHEN id % 3 = 0 THEN NULL ELSE 5L END AS turn", "'user' AS role", "concat('t', id % 100) AS text")
    got = chat.format_chats(rows).collect()
    assert sorted(r.position for r in got) == list(range(3000))
    assert max(r.position for r in got if r.turn == 5) < min(r.position for r in got if r.turn is None)


def test_declared_tools(spark):
    js = lambda x: json.dumps(x)
    add = {"name": "add", "parameters": {"properties": {"a": {"type": "number"}, "b": {"type": ["integer", "null"]}, "c": {}}, "required": ["a"]}}
    calls = [call("c1", "add", {"a": 1, "b": 2, "c": "x"}), call("c2", "add", {"b": 2}), call("c3", "add", {"a": 1, "b": 1.5}), call("c4", "now", {}), call("c5", "nope", {})]
    said = js({"tool_calls": calls})
    again = {"tools": [{"name": "add", "parameters": {"properties": {}}}]}
    rows = [(1, 0, "system", js({"tools": [{"type": "function", "function": add}, {"name": "now"}]})), (1, 1, "assistant", said), (1, 2, "system", js(again)), (2, 0, "assistant", said), (2, 1, "assistant", js({"tool_calls": [call(None, "add", {"a": 1})]})), (3, 0, "user", "hi")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {(r.conv_id, r.turn): r for r in chat.format_chats(df).collect()}
    valid = lambda r: [c["valid"] for c in json.loads(r.message)["tool_calls"]]
    assert valid(got[1, 1]) == [True, False, False, True, False] and got[1, 1].n_valid == 2
    # No tools are declared here: nothing is checked, except that a call without an identifier is invalid.
    assert valid(got[2, 0]) == [None] * 5 and got[2, 0].n_valid is None and got[2, 0].n_calls == 5
    assert valid(got[2, 1]) == [False] and got[2, 1].n_valid == 0
    assert got[3, 0].n_valid == 0
    none = chat.format_chats(df, chat.tool_schemas(spark, {})).where("conv_id = 2 AND turn = 0").first()
    assert valid(none) == [False] * 5 and none.n_valid == 0


def test_targets():
    got = {s.source: s.target for s in mixing.targets({"a": 10, "b": 1000, "c": 100, None: 90})}
    assert got["a"] == 30 and got["c"] == 300
    assert abs(sum(got.values()) - 1200) < 1e-6
    assert mixing.targets({}) == []


def test_mix(docs, no_docs, spark):
    rows = mixing.plan(docs).collect()
    assert len(rows) == 10
    for src in {r.source_size for r in rows}:
        assert src >= 0
    for r, t in ((r, r.target) for r in rows):
        assert 0 <= r.taken <= 3 * r.size and t >= 0
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    plan = mixing.plan(d, keep=["source"]).groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("target")).collect()
    assert all(abs(r.t - r.target) < 1 for r in plan)
    mixed = mixing.mix(d)
    got = [r.position for r in mixed.select("position").collect()]
    assert got == sorted(got) and 0 <= got[0] and got[-1] <= 1
    words = mixed.select(F.sum(mixing.word_count(F.col("text")))).first()[0]
    assert abs(words / sum(r.target for r in plan) - 1) < 0.1
    assert mixing.mix(no_docs).count() == 0
    assert mixing.mix(docs).columns == [*docs.columns, "position"]


def test_ranges_change_no_result(docs, spark, monkeypatch):
    assert [mixing.digits(n) for n in (0, 16**3 * mixing.RANGE_ROWS, 16**3 * mixing.RANGE_ROWS + 1, 10**11)] == [3, 3, 4, 6]
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    other = docs.select("doc_id", "text", F.concat(F.lit("-"), "source").alias("source")).unionAll(docs.select("doc_id", "text", F.lit("-")))

    def rows() -> list:
        return [sorted(map(repr, mixing.plan(x).collect())) for x in (d, docs, other)] + [mixing.mix(d).collect()]

    few = rows()
    monkeypatch.setattr(mixing, "DIGITS", 1)
    monkeypatch.setattr(mixing, "RANGE_ROWS", 1)
    assert rows() == few


def test_schedule_inverts(spark):
    for s in (-1.0, -0.5, 0.0, 0.5, 1.0):
        for r in spark.range(11).select((F.col("id") / 10).alias("t")).select("t", mixing.when(mixing.due(F.col("t"), F.lit(s)), F.lit(s)).alias("b")).collect():
            assert r.b is None or abs(r.t - r.b) < 1e-9


def test_words_are_the_contracts(spark):
    t = " a\tb\x0bc d  e\n"
    (r,) = spark.createDataFrame([(t,)], "t string").select(mixing.word_count(F.col("t")).alias("n")).collect()
    assert r.n == len(re.findall(r"[^\x20\x09-\x0D]+", t))
