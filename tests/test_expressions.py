import csv
import io
import itertools
import random

from pyspark.sql import functions as F

from feedelta.api import diff_tables
from feedelta.functions.csvtext import csv_line
from feedelta.functions.equality import differs
from feedelta.operators.table import Table


def model(a, b):
    a, b = a.strip(), b.strip()
    if a.lower() == b.lower():
        return False
    try:
        return float(a) != float(b)
    except ValueError:
        return True


VALUES = ["", " ", "a", "A ", "\ta", "1", "1.0", "01", "+1", "1e0", "1E+00", "1.", ".5", "0.50", "1d", "1f", "0x1", "inf", "-Infinity", "nan", "NaN", "+nan", "1_0", "10", "1__0", "_1", "é", "É", " x", "x ", "1 2", "-0", "0", "1e400", "9007199254740993", "9007199254740992", "."]


def test_tolerant_equality_is_pythons(spark):
    pairs = list(itertools.product(VALUES, VALUES))
    rows = spark.createDataFrame(pairs, "a string, b string").select("a", "b", differs(F.col("a"), F.col("b")).alias("d")).collect()
    assert [(r.a, r.b) for r in rows if r.d != model(r.a, r.b)] == []


def test_csv_line_is_the_csv_modules(spark):
    rng = random.Random(3)
    rows = [tuple("".join(rng.choice('ab,"\n\r é') for _ in range(rng.randrange(5))) for _ in range(3)) for _ in range(300)]

    def want(cells):
        out = io.StringIO()
        csv.writer(out, lineterminator="").writerow(cells)
        return out.getvalue()

    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, a string, b string, c string")
    got = df.select("i", csv_line([F.col("a"), F.col("b"), F.col("c")]).alias("l"), csv_line([F.col("a")]).alias("one")).orderBy("i").collect()
    assert [r.l for r in got] == [want(r) for r in rows]
    assert [r.one for r in got] == [want(r[:1]) for r in rows]


def test_random_tables_against_a_model(spark):
    rng = random.Random(5)
    for _ in range(4):
        side = lambda: {f"k{i}": (rng.choice(VALUES), rng.choice(VALUES)) for i in rng.sample(range(60), rng.randrange(20, 60))}
        b, n = side(), side()
        table = lambda s: Table.of(spark.createDataFrame([(i, k, *v) for i, (k, v) in enumerate(s.items(), 2)], "line long, k string, x string, y string"))
        d = diff_tables(table(b), table(n), ["k"], churn_threshold=2)
        changed = {k: [c for c, p, q in zip("xy", b[k], n[k], strict=True) if model(p, q)] for k in b.keys() & n.keys()}
        rows = d["row_changes"]
        assert {r["identifier"]["k"] for r in rows["added"]} == n.keys() - b.keys()
        assert {r["identifier"]["k"] for r in rows["deleted"]} == b.keys() - n.keys()
        assert {r["identifier"]["k"]: [c["field"] for c in r["field_changes"]] for r in rows["modified"]} == {k: v for k, v in changed.items() if v}
        assert [r["base_line_number"] for r in rows["modified"]] == sorted(r["base_line_number"] for r in rows["modified"])
