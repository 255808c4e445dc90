import duckdb
import pandas as pd

import corpus_pipeline
from feedelta.llm import queries

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == corpus_pipeline.COLUMNS, name
        docs = out
    got = corpus_pipeline.run(spark, SF)
    assert got.count() == docs.count() > 0 and got.where("n_tokens = 0").count() == 0


def stage(name):
    return dict(corpus_pipeline.STAGES)[name]


def test_stages_take_effect(spark):
    """Every stage removes what it should, keeps the rest, and goes by what the stage before has left."""
    some = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("lang = 'en' AND n_chars BETWEEN 500 AND 1500")
    prose = sorted({r.text[:60]: r.text for r in some.collect()}.values())[:40]
    words = lambda t: " ".join(t.split())
    rows = [(i, words(t), "en", f"s{i % 12}") for i, t in enumerate(prose)]
    near = words(prose[3]).split()
    near[len(near) // 2] = "changed"
    rows += [
        (100, words(prose[3]), "en", "s1"),
        (101, " ".join(near), "en", "s2"),
        (102, "12 34 !!", "en", "s1"),
        (103, None, None, None),
        (104, "", "en", "s1"),
        (105, "xq zvkj wpq ghtk zzqx vvbn mkjh qwrt plkj hgfd sdfg zxcv bnmq wert yuio pasd " * 8, None, "s1"),
    ]
    rows += [(200 + i, f"{words(prose[20 + i])} {i}\nsame line on every site of these", "en", f"s{i}") for i in range(12)]
    docs = spark.createDataFrame([(i, t, k, s, len(t or "")) for i, t, k, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    one = stage("language ID")(spark, docs, SF)
    assert {r.doc_id for r in one.collect()} == {i for i, *_ in rows} - {102, 103, 104, 105}
    two = {r.doc_id: r for r in stage("line dedup")(spark, one, SF).collect()}
    assert len(two) == one.count() and two[200].text.endswith("these") and "same line" not in two[205].text
    assert all(r.n_chars == len(r.text) for r in two.values())
    three = stage("near-dedup")(spark, spark.createDataFrame(list(two.values()), docs.schema), SF)
    left = {r.doc_id for r in three.collect()}
    assert left & {3, 100, 101} == {3} and set(range(20)) <= left
    four = stage("mixing")(spark, three, SF)
    times = {r.doc_id: r["count"] for r in four.groupBy("doc_id").count().collect()}
    assert set(times) <= left and max(times.values()) <= 3
    five = stage("BPE")(spark, four, SF)
    assert five.count() == four.count() and five.where("n_tokens < 50").count() == 0


def test_stages_on_odd_tables(spark, docs, no_docs):
    fit = lambda d: d.selectExpr("doc_id", "text", "lang", "source", "length(text) AS n_chars", "'x' AS kept", "1 AS position", "2 AS n_lines")
    for d in (fit(docs), fit(no_docs)):
        for name, f in corpus_pipeline.STAGES[:-1]:
            got = f(spark, d, SF)
            assert got.columns == corpus_pipeline.COLUMNS and got.count() <= 3 * d.count(), name
        assert corpus_pipeline.tokens(spark, d, SF).count() == d.count()


def test_sql(spark):
    con = duckdb.connect()
    for t in ("documents", "conversations", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    for name, sql in queries.ORACLE_SQL.items():
        got, want = queries.QUERIES[name](spark, SF).toPandas(), con.execute(sql).df()
        cols = sorted(want.columns)
        assert sorted(got.columns) == cols, name
        rows = lambda df: sorted((tuple(None if pd.isna(v) else v for v in r) for r in df[cols].astype(object).itertuples(index=False, name=None)), key=str)  # noqa: E731, B023
        got, want = rows(got), rows(want)
        assert len(got) == len(want), name
        for x, y in zip(got, want, strict=True):
            assert all(abs(a - b) < 1e-9 if isinstance(a, float) and b is not None else a == b for a, b in zip(x, y, strict=True)), (name, x, y)
