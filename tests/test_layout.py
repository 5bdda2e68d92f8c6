"""Windows, layout JSON and block normalisation on hand-worked rows."""

import json
import math
import random

import pytest
from pyspark.sql import functions as F

from leafmill.functions import geometry as G
from leafmill.functions import variants as V
from leafmill.operators import blocks as B
from leafmill.operators import merge as M
from leafmill.operators import windows as W
from leafmill.plans import parse
from leafmill.plans.parse import merged_items, parse_documents, scanned_items
from leafmill.sources import layout as L

MB = 1024 * 1024


def plan(spark, rows):
    df = spark.createDataFrame(rows, "id string, page_count int, bytes bigint, s int, e int, c int, o int")
    out = W.plan_chunks(df, "s", "e", "c", "o").orderBy("document_id", "chunk_ord").collect()
    got = {}
    for r in out:
        got.setdefault(r.document_id, []).append((r.start_page, r.end_page))
    return got


def test_plan_golden(spark):
    got = plan(
        spark,
        [
            ("a", 100, MB, None, None, None, None),
            ("b", 10, 3 * MB, None, None, None, None),
            ("c", 40, 4 * MB, None, None, None, None),
            ("d", 0, MB, None, None, None, None),
            ("e", 10, MB, 4, None, 0, None),
            ("f", 10, MB, 0, 99, 3, 0),
            ("g", 5, MB, 0, None, 0, 7),
        ],
    )
    assert got["a"] == [(0, 23), (22, 45), (44, 67), (66, 89), (88, 99)]
    assert got["b"] == [(0, 7), (7, 9)]
    assert got["c"] == [(0, 15), (15, 30), (30, 39)]
    assert "d" not in got
    assert got["e"] == [(4, 9)]
    assert got["f"] == [(0, 2), (3, 5), (6, 8), (9, 9)]
    # Both sizes given: a window of 0 becomes 1.
    assert got["g"] == [(i, i) for i in range(5)]


def test_windows_cover_every_page(spark):
    rng = random.Random(7)
    rows = []
    for i in range(300):
        n = rng.randint(1, 400)
        size = rng.choice([None, rng.randint(1, 30)])
        lap = None if size is None else rng.choice([None, rng.randint(0, 40)])
        rows.append((str(i), n, rng.randint(0, 200) * MB, 0, None, size, lap))
    got = plan(spark, rows)
    for key, n, *_ in rows:
        spans = got[key]
        assert spans[0][0] == 0 and spans[-1][1] == n - 1
        for (s1, e1), (s2, e2) in zip(spans, spans[1:]):
            assert s1 < s2 <= e1 + 1 and e2 > e1


def test_bbox_golden(spark):
    rows = [
        ([0.1, 0.2, 0.3, 0.4], None, [0.1, 0.2, 0.3, 0.4]),
        ([100.0, 200.0, 300.0, 400.0], [595.0, 842.0], [100 / 595, 200 / 842, 300 / 595, 400 / 842]),
        ([900.0, 900.0, 1000.0, 1000.0], [595.0, 842.0], [0.9, 0.9, 1, 1]),
        ([100.0, 100.0, 500.0, 500.0], None, [0.1, 0.1, 0.5, 0.5]),
        ([1200.0, 10.0, 1500.0, 20.0], None, [1, 1, 1, 1]),
        ([1.0, 2.0], None, [0, 0, 0, 0]),
        (None, None, [0, 0, 0, 0]),
    ]
    df = spark.createDataFrame([(i, b, s) for i, (b, s, _) in enumerate(rows)], "i int, b array<double>, s array<double>")
    got = df.select("i", G.normalize_bbox(F.col("b"), F.col("s")).alias("n")).orderBy("i").collect()
    for r, (_, _, want) in zip(got, rows):
        assert all(math.isclose(a, b) for a, b in zip(r.n, want)), (r, want)


@pytest.mark.parametrize(
    ("value", "want"),
    [
        ("  a b ", "a b"),
        ("", None),
        (["x", "", " y ", None], "x\ny"),
        ({"content": "c", "text": None}, None),
        ({"paragraph_content": [{"content": "p"}, {"text": "q"}]}, "p\nq"),
        ({"other": 1}, None),
        ([], None),
        (7, "7"),
        (True, "True"),
        (None, None),
        ("[1] a reference", "[1] a reference"),
        (100.0, "100.0"),
        (1.5, "1.5"),
        ([[[[[[{"text": [{"content": "deep"}, 3]}]]]]]], "deep\n3"),
        ([{"content": [{"content": "kept"}]}], "kept"),
    ],
)
def test_join_text(spark, value, want):
    df = spark.createDataFrame([(json.dumps({"v": value}),)], "j string")
    df = df.select(F.array(F.try_variant_get(F.parse_json("j"), "$.v", "variant")).alias("v"))
    assert df.select(V.join_texts("v").alias("t")).first().t[0] == want


def test_layout_shapes(spark):
    rows = [
        ("flat", '[{"text":"a","page_idx":2},5,{"text":"b"}]'),
        ("nested", '[[{"text":"a"},1],[{"text":"b","page_idx":0},{"text":"c"}]]'),
        ("string", json.dumps('[{"text":"a"}]')),
        ("object", '{"text":"a"}'),
        ("bad", "[{"),
        ("null", None),
    ]
    df = spark.createDataFrame(rows, "document_id string, payload string")
    out = L.layout_items_scan(df, ["document_id"])
    got = {(r.document_id, r.pos): r.page_idx for r in out.select("document_id", "pos", "page_idx").collect()}
    assert got == {
        ("flat", 0): 2,
        ("flat", 1): None,
        ("nested", 0): 0,
        ("nested", 1): 0,
        ("nested", 2): 1,
        ("string", 0): None,
    }


def chunk_rows(spark, starts):
    rows = [("d", i, f"c{i:04d}", s, "completed") for i, s in enumerate(starts, start=1)]
    return spark.createDataFrame(rows, "document_id string, chunk_ord int, chunk_id string, start_page int, status string")


def items_json(pages):
    return json.dumps([{"text": f"{c} p{p}", "page_idx": p} for c, p in pages])


def test_overlap_keep_first(spark):
    chunks = chunk_rows(spark, [0, 1])
    both = [("d", 1, items_json([("one", 0), ("one", 1)])), ("d", 2, items_json([("two", 0), ("two", 1), ("two", 2)]))]
    df = spark.createDataFrame(both, "document_id string, chunk_ord int, payload string")
    kept = M.overlap_keep_first(M.rebase_page(L.layout_items_scan(df, ["document_id", "chunk_ord"]), chunks))
    got = sorted((r.page_idx, r.chunk_ord) for r in kept.collect())
    assert got == [(0, 1), (1, 1), (2, 2), (3, 2)]
    # An empty page in the first window is taken from the second.
    gap = [("d", 1, items_json([("one", 0)])), both[1]]
    df = spark.createDataFrame(gap, "document_id string, chunk_ord int, payload string")
    kept = M.overlap_keep_first(M.rebase_page(L.layout_items_scan(df, ["document_id", "chunk_ord"]), chunks))
    assert sorted((r.page_idx, r.chunk_ord) for r in kept.collect()) == [(0, 1), (1, 2), (2, 2), (3, 2)]


def test_normalize_items(spark):
    items = [
        {"type": "table", "table_body": "<table></table>", "table_caption": ["Table 1"], "bbox": [1, 2, 3, 4]},
        {"text": ""},
        {"type": "title", "text": "   ", "content": "Heading", "page_no": 3},
        {"type": "image", "img_path": "a.png", "page_idx": 0, "page_no": 2},
        {"text": "Fig 2 shows", "image_caption": "Fig 2", "reading_order": 77, "page_size": [100, 200], "bbox": [10, 20, 50, 100]},
    ]
    df = spark.createDataFrame([("d", 1, json.dumps(items))], "document_id string, chunk_ord int, payload string")
    scan = L.layout_items_scan(df, ["document_id", "chunk_ord"]).withColumn("item_index", F.col("pos"))
    out = B.normalize_blocks(B.item_columns(scan, ["document_id", "page_idx", "item_index"]))
    got = {r.id: r for r in out.collect()}
    assert set(got) == {"d-0", "d-2", "d-3", "d-4"}
    assert got["d-0"].text == "Table 1\n<table></table>" and got["d-0"].reading_order == 0
    assert got["d-2"].text == "Heading" and got["d-2"].page_no == 3 and got["d-2"].reading_order == 2
    assert got["d-3"].text is None and got["d-3"].page_no == 2 and got["d-3"].image_path == "a.png"
    assert got["d-4"].text == "Fig 2 shows" and got["d-4"].reading_order == 77
    assert [round(x, 3) for x in got["d-4"].bbox_norm] == [0.1, 0.1, 0.5, 0.5]
    assert json.loads(got["d-0"].meta.table_caption) == ["Table 1"]


def test_tree_stands_in_only_without_items(spark):
    tree = {
        "pdf_info": [
            {
                "page_idx": 0,
                "page_size": [600, 800],
                "para_blocks": [],
                "preproc_blocks": [{"type": "text", "bbox": [60, 80, 300, 400], "lines": [{"spans": [{"content": "ab"}, {"content": ""}, {"content": "c"}]}]}],
            }
        ]
    }
    chunks = spark.createDataFrame(
        [("d", 1, "c0001", 0, "completed"), ("e", 1, "c0001", 4, "completed")],
        "document_id string, chunk_ord int, chunk_id string, start_page int, status string",
    )
    payloads = spark.createDataFrame([("d", 1, '[{"text":"own","bbox":[60,80,300,400]}]'), ("e", 1, "[]")], "document_id string, chunk_ord int, payload string")
    trees = spark.createDataFrame([("d", 1, json.dumps(tree)), ("e", 1, json.dumps(tree))], "document_id string, chunk_ord int, payload string")
    got = {r.document_id: r for r in parse_documents(payloads, chunks, trees=trees).collect()}
    assert got["d"].text == "own" and got["e"].text == "abc"
    assert got["e"].page_no == 5
    # The tree's page size scales both documents' boxes.
    for r in got.values():
        assert [round(x, 3) for x in r.bbox_norm] == [0.1, 0.1, 0.5, 0.5]


def test_texts_of_windows_move_before_they_are_parsed(spark, monkeypatch):
    plans = {}
    monkeypatch.setattr(parse, "materialize", lambda df, label, *codec: plans.update({label: df._jdf.queryExecution().optimizedPlan().toString()}) or df)
    chunks = chunk_rows(spark, [0, 2])
    df = spark.createDataFrame([("d", 1, items_json([("a", 1)])), ("d", 2, items_json([("b", 1)]))], "document_id string, chunk_ord int, payload string")
    got = sorted((r.page_idx, r.chunk_ord) for r in parse.scanned_items(df, chunks).collect())
    assert got == [(1, 1), (3, 2)]
    trees = spark.createDataFrame([("d", 2, '{"pdf_info": [{"page_idx": 1}, {}]}'), ("d", 3, '{"pdf_info": [{}]}')], df.schema)
    got = parse.scanned_trees(trees, chunks)
    assert got.columns == ["document_id", "chunk_ord", "pos", "page", "page_idx", "chunk_id"]
    assert sorted((r.chunk_ord, r.pos, r.page_idx) for r in got.collect()) == [(2, 0, 3), (2, 1, 2)]
    for plan in plans.values():
        assert 0 <= plan.index("Generate posexplode") < plan.index("Join Inner"), plan


def test_merged_index_is_document_wide(spark):
    chunks = chunk_rows(spark, [0, 2])
    rows = [("d", 1, items_json([("a", 0), ("a", 1), ("a", 2)])), ("d", 2, items_json([("b", 0), ("b", 1)]))]
    df = spark.createDataFrame(rows, "document_id string, chunk_ord int, payload string")
    got = sorted((r.item_index, r.body) for r in merged_items(scanned_items(df, chunks)).collect())
    assert got == [(0, "a p0"), (1, "a p1"), (2, "a p2"), (3, "b p1")]


def test_summary_and_report(spark):
    rows = [("a", i, f"c{i:04d}", s) for i, s in enumerate(["completed", "failed", "pending", "retrying"], 1)]
    rows += [("b", 1, "c0001", "completed"), ("b", 2, "c0002", "failed")]
    df = spark.createDataFrame(rows, "document_id string, chunk_ord int, chunk_id string, status string")
    s = {r.document_id: r for r in W.chunk_summary(df).collect()}
    assert (s["a"].current_ord, s["a"].overall, s["a"].percent) == (4, "parsing", 25)
    assert (s["b"].current_ord, s["b"].overall, s["b"].percent) == (None, "chunks_done", 50)
    m = {r.document_id: r for r in W.merge_report(df).collect()}
    assert m["a"].merged == "merged_1_of_4_chunks" and m["a"].incomplete == "incomplete_chunks:c0002,c0003,c0004"


def test_merged_markdown(spark):
    rows = [("d", 1, "c0001", 0, 1, "one\n"), ("d", 2, "c0002", 1, 2, "two \n\n"), ("d", 3, "c0003", 3, 4, None)]
    df = spark.createDataFrame(rows, "document_id string, chunk_ord int, chunk_id string, start_page int, end_page int, text string")
    pieces = [r.piece for r in M.merged_markdown(df).orderBy("chunk_ord").collect()]
    tag = "<!-- " + M.X.CHUNK_COMMENT.split()[1]
    assert "".join(pieces) == f"{tag} c0001 pages 1-2 -->\n\none\n\n\n{tag} c0002 pages 2-3 -->\n\ntwo\n"
