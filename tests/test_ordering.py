"""Order-dependent helpers and the hit test against plain Python, with one hot group."""

import random
import re

import pytest
from pyspark.sql import functions as F

from leafmill.functions import ordering as O
from leafmill.operators import views as V


@pytest.fixture(scope="module")
def hot_rows():
    """A third of all rows in one document, much of it on one page."""
    rng = random.Random(3)
    rows = []
    for i in range(9000):
        doc = "hot" if i % 3 == 0 else f"d{rng.randint(0, 60)}"
        page = rng.choice([1, 1, 1, rng.randint(1, 6000)])
        rows.append((doc, page, rng.randint(0, 5000), f"i{i:05d}"))
    return rows


@pytest.fixture(scope="module")
def hot(spark, hot_rows):
    return spark.createDataFrame(hot_rows, "document_id string, page_no int, reading_order int, id string")


def test_dense_position(hot, hot_rows):
    got = {r.id: r.p for r in O.dense_position(hot, ["document_id"], "page_no", "reading_order", ["id"], "p").collect()}
    want, seen = {}, {}
    for doc, _, _, i in sorted(hot_rows):
        want[i] = seen.setdefault(doc, 0)
        seen[doc] += 1
    assert got == want


def test_gather_and_text(hot, hot_rows):
    want = {}
    for doc, page, _, i in sorted(hot_rows):
        want.setdefault((doc, page), []).append(i)
    arrays = O.gather(hot, ["document_id", "page_no"], ["reading_order", "id"], ids=F.col("id")).collect()
    assert {(r.document_id, r.page_no): list(r.ids) for r in arrays} == want
    texts = O.gather_text(hot, ["document_id", "page_no"], ["reading_order", "id"], F.col("id"), ",", "t").collect()
    assert {(r.document_id, r.page_no): r.t.split(",") for r in texts} == want


def test_first_n(hot, hot_rows):
    got = O.first_n_per_key(hot, ["document_id"], ["page_no", "reading_order", "id"], 30)
    want, seen = set(), {}
    for doc, _, _, i in sorted(hot_rows):
        seen[doc] = seen.get(doc, 0) + 1
        if seen[doc] <= 30:
            want.add(i)
    assert {r.id for r in got.collect()} == want


def test_first_per_key_limits_before_the_shuffle(hot):
    plan = O.first_per_key(hot, ["document_id"], ["id"])._jdf.queryExecution().executedPlan().toString()
    partial = plan.index("Partial")
    assert plan.index("Exchange hashpartitioning") < partial  # printed top-down: the limit lies below the exchange


def hit(page, x, y, boxes):
    best = None
    for doc, p, rank, kind, i, b in boxes:
        if p == page and min(b[0], b[2]) <= x <= max(b[0], b[2]) and min(b[1], b[3]) <= y <= max(b[1], b[3]):
            area = abs(b[2] - b[0]) * abs(b[3] - b[1])
            key = (area, rank, i)
            best = min(best or (key, kind), (key, kind))
    return best and (best[1], best[0][2])


def test_hit_test_brute_force(spark):
    rng = random.Random(11)
    boxes = []
    for i in range(600):
        page = 1 if i % 3 else rng.randint(2, 5)
        c = [rng.choice([0.0, 0.25, 0.5, 1.0, rng.random()]) for _ in range(4)]
        if i % 4 == 0:  # boxes of all sizes, down to points
            w = rng.choice([0.0, 1e-5, 0.001, 0.03, 0.125])
            c = [c[0], c[1], c[0] + w, c[1] + w * rng.random()]
        if i % 50 == 0:
            c = [-3.0, 0.1, 40.0, 7.0]
        rank = rng.randint(0, 2)
        boxes.append(("d", page, rank, ["block", "reaction", "table"][rank], f"x{i:04d}", c))
    clicks = [(i, "d", rng.choice([1, 1, 2, 3, 9]), rng.choice([0.0, 0.5, 1.0, rng.random()]), rng.choice([0.0, 0.25, rng.random(), 5.0])) for i in range(800)]
    b = spark.createDataFrame(boxes, "document_id string, page_no int, kind_rank int, kind string, id string, bbox array<double>").withColumn("seq", F.struct("id"))
    c = spark.createDataFrame(clicks, "click_id int, document_id string, page_no int, x double, y double")
    got = {r.click_id: (r.kind, r.id) for r in V.hit_test(c, b).collect()}
    want = {i: hit(p, x, y, boxes) for i, _, p, x, y in clicks}
    assert got == {k: v for k, v in want.items() if v}


def test_hit_golden(spark):
    rows = [
        ("d", 1, 0, "block", "b", [0.0, 0.0, 1.0, 1.0]),
        ("d", 1, 1, "reaction", "r", [0.6, 0.6, 0.2, 0.2]),
        ("d", 1, 2, "table", "t", [0.2, 0.2, 0.6, 0.6]),
    ]
    b = spark.createDataFrame(rows, "document_id string, page_no int, kind_rank int, kind string, id string, bbox array<double>").withColumn("seq", F.struct("id"))
    c = spark.createDataFrame([(1, "d", 1, 0.5, 0.5), (2, "d", 1, 0.9, 0.9), (3, "d", 2, 0.5, 0.5)], "click_id int, document_id string, page_no int, x double, y double")
    assert {r.click_id: r.id for r in V.hit_test(c, b).collect()} == {1: "r", 2: "b"}


def test_hit_many_wide_boxes_on_one_page(spark):
    n = 100_000
    b = spark.range(n).selectExpr(
        "'d' as document_id", "1 as page_no", "0 as kind_rank", "'block' as kind", "cast(id as string) as id",
        "array(0.01 + id * 1e-7, 0.01D, 0.99D, 0.99D) as bbox", "struct(id) as seq",
    )
    c = spark.range(40).selectExpr("id as click_id", "'d' as document_id", "1 as page_no", "0.05 + 0.9 * id / 40 as x", "0.5D as y")
    got = {r.id for r in V.hit_test(c.withColumn("x", F.col("x").cast("double")), b).collect()}
    assert got == {str(n - 1)}


def test_search_folds_ascii_only(spark):
    df = spark.createDataFrame([("d", 1, i, str(i), t) for i, t in enumerate(["ABC", "xabcx", "É", "é", "a%c", "a_c", "a\\c"])], "document_id string, page_no int, reading_order int, id string, text string")

    def found(q):
        return sorted(r.id for r in V.search_blocks(df, q).collect())

    assert found("aBc") == ["0", "1"]
    assert found("é") == ["3"]
    assert found("A_C") == ["0", "1", "4", "5", "6"]
    assert found("a\\c") == ["6"]


def test_page_filter_zero_means_all(hot):
    assert V.blocks_by_page(hot, "hot", 0).count() == V.blocks_by_page(hot, "hot").count() > V.blocks_by_page(hot, "hot", 1).count()


def test_ends_meet_rows_on_the_whole_key(spark):
    rows = [("a", 1, "x"), ("a", 1, "y"), ("a", 3, "z"), ("b", 2, "q"), (None, 1, "n")]
    df = spark.createDataFrame(rows, "g string, at int, id string")
    got = {(r.g, r.id): (r.opens, r.closes) for r in O.with_ends(df, "g", ["at", "id"]).collect()}
    assert got == {("a", "x"): (True, False), ("a", "y"): (False, False), ("a", "z"): (False, True), ("b", "q"): (True, True), (None, "n"): (False, False)}
    plan = O.with_ends(df, "g", ["at", "id"])._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join" in line]
    assert len(joins) == 1 and all(c in joins[0] for c in ("g#", "at#", "id#"))


def _exchanges(df):
    """Shuffles of the plan as it ran, by what they deal rows by."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    return re.findall(r"(?<!Reused)Exchange hashpartitioning\((.*?), \d+\)", plan)


def test_rows_of_a_page_move_once(hot):
    group, order = ["document_id", "page_no"], ["reading_order", "id"]
    for df in (O.gather(hot, group, order, ids=F.col("id")), O.gather_text(hot, group, order, F.col("id"), ",", "t")):
        assert len(_exchanges(df)) == 1


def test_rows_carry_their_order_columns_once(hot, hot_rows):
    got = O.gather_rows(hot, ["document_id", "page_no"], ["reading_order", "id"])
    assert got.schema["rows"].dataType.elementType.names == ["reading_order", "id"]
    assert sum(len(r.rows) for r in got.collect()) == len(hot_rows)
