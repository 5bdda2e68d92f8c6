"""HTML tables, stored tables, exports and reviews."""

import glob
import json
import re

import pytest
from pyspark.sql import functions as F

from leafmill.operators import catalogue as C
from leafmill.operators import html_tables as H
from leafmill.operators import review as R
from leafmill.plans.extract import extract_tables
from leafmill.sources import files as FS
from leafmill.sources import stored as ST


def parse(spark, html):
    return H.parsed_tables(spark.createDataFrame([("t", html)], "id string, html string")).first()


def column(spark, cells):
    rows = "".join(f"<tr><td>{i}</td><td>{c}</td></tr>" for i, c in enumerate(cells))
    parsed = H.parsed_tables(spark.createDataFrame([("t", f"<table><tr><th>k</th><th>v</th></tr>{rows}</table>")], "id string, html string"))
    typed = H.typed_cells(parsed, ["id"]).filter("col = 1").orderBy("row").collect()
    return typed[0].type, [next((x for x in (r.long_value, r.double_value, r.string_value) if x is not None), None) for r in typed]


@pytest.mark.parametrize(
    ("cells", "want"),
    [
        (["12", "—"], ("long", [12, None])),
        (["12", "1.5"], ("double", [12.0, 1.5])),
        (["85%", "7"], ("double", [85.0, 7.0])),
        (["85%", "x"], ("string", ["85.0", "x"])),
        (["NA", ""], ("boolean", [None, None])),
        (["007", "x"], ("string", ["7", "x"])),
        (["-3", "+4"], ("string", ["-3", "+4"])),
    ],
)
def test_cell_inference(spark, cells, want):
    assert column(spark, cells) == want


def test_headers_rows_and_flags(spark):
    p = parse(
        spark,
        "<p>x</p><TABLE class='a'><tr><th> Yield  (%) </th><th>Yield</th><th></th><th>收率·%</th></tr>"
        "<tr><td>1</td></tr><tr><td> </td><td></td></tr><tr><td>a &amp;lt; b</td><td>2</td><td>3</td><td>4</td><td>5</td></tr></TABLE><table><tr><td>z</td></tr></table>",
    )
    assert list(p.headers) == ["Yield", "Yield_2", "col_3", "收率"]
    assert [list(r) for r in p.rows] == [["1", "", "", ""], ["a &lt; b", "2", "3", "4"]]
    assert p.malformed is False
    loose = parse(spark, "<table><tr><td>h<td>i</tr><tr><td>1<td>2</tr></table>")
    assert list(loose.headers) == ["h", "i"] and [list(r) for r in loose.rows] == [["1", "2"]] and not loose.malformed
    assert list(parse(spark, "no table").headers) == [] and list(parse(spark, None).rows) == []


def grid(spark, html):
    g = spark.createDataFrame([(html,)], "h string").select(H.table_grid(F.col("h")).alias("g")).first().g
    return None if g is None else ([list(r) for r in g.rows], g.closed)


NESTED = "<tr><td>1<td>x<table><tr><td>n1</td><td>n2<tr><td>n3</table>y</td><td>3</td></tr>"


@pytest.mark.parametrize(
    ("html", "rows", "closed"),
    [
        # A cell's table: the row goes on behind it, and the inner rows follow as rows of their own.
        (f"a<table>{NESTED}<tr><td>4</table>", [["1", "x n1 n2 n3 y", "n1", "n2", "n3", "3"], ["n1", "n2"], ["n3"], ["4"]], True),
        # Rows and cells without end tags, sections in between, upper case, attributes.
        ("<TABLE b=1><THEAD><TR><TH>h<TH>i<TBODY><TR><TD>1<TD>2<tr>\n<td>3</TABLE>", [["h", "i"], ["1", "2"], ["3"]], True),
        ("<table><tr><td>a</tr></td><td>lost</td><tr><td>b<br>c</td>out</tr>", [["a"], ["b c"]], False),
        # End tags without a start, a cell without a row, an empty row.
        ("<table></td></tr><td>no row</td><tr></tr><tr><td>z</td></tr></table><tr><td>behind</td></tr>", [[], ["z"]], True),
        ("<table><!-- <tr><td>no</td></tr> --><tr><td><!-- </td> -->q</td></tr></table>", [["q"]], True),
        ("<table><tr><td>a<table></table></td><td>b<table><tr><td>c<table><tr><td>d</table></table></td></tr></table>", [["a", "b c d", "c d", "d"], ["c d", "d"], ["d"]], True),
        ("<tablet><tr><td>1</td></tr></tablet>", None, None),
        ("<table>", [], False),
        ("", None, None),
        (None, None, None),
    ],
)
def test_tag_stack(spark, html, rows, closed):
    assert grid(spark, html) == (None if rows is None else (rows, closed))


def test_runs_of_tags_join(spark, monkeypatch):
    html = "<table>" + "".join(f"<tr><td>{i}<td>{i + 1}" for i in range(500)) + NESTED + "</table>"
    want = [[str(i), str(i + 1)] for i in range(500)] + [["1", "x n1 n2 n3 y", "n1", "n2", "n3", "3"], ["n1", "n2"], ["n3"]]
    assert grid(spark, html) == (want, True)
    monkeypatch.setattr(H, "RUN", 7)
    assert grid(spark, html) == (want, True)


def test_long_table_ends(spark):
    html = "<table>" + "<tr><td>1<td>2<td>3</tr>" * 20_000 + "</table>"
    rows, closed = grid(spark, html)
    assert closed and len(rows) == 20_000 and rows[-1] == ["1", "2", "3"]


def test_a_thousand_schemas_in_one_job(spark, tmp_path):
    html = F.concat(F.lit("<table><tr><th>k</th><th>v"), F.col("id"), F.lit("</th></tr><tr><td>"), F.col("id"), F.when(F.col("id") % 2 == 0, "</td><td>1.5").otherwise("</td><td>x"), F.lit("</td></tr></table>"))
    parsed = H.parsed_tables(spark.range(1000).select(F.col("id").cast("string").alias("id"), html.alias("html")))
    path = str(tmp_path / "typed")
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("typed", "typed")
    H.write_typed_tables(parsed, ["id"], path, buckets=4)
    assert len(tracker.getJobIdsForGroup("typed")) <= 2  # the write, and its shuffle run ahead by AQE
    spark.sparkContext.setJobGroup("rest", "rest")
    stored = spark.read.parquet(path)
    schemas = H.table_schemas(stored).collect()
    assert len(schemas) == 1000 and {(r.tables, r.records) for r in schemas} == {(1, 1)}
    wide = H.widened(stored, ["id"], [("k", "long"), ("v7", "string")], buckets=4)
    assert [tuple(r) for r in wide.collect()] == [("7", 0, 7, "x")]
    assert [tuple(r) for r in H.widened(stored, ["id"], [("k", "long"), ("v8", "double")], buckets=4).collect()] == [("8", 0, 8, 1.5)]
    plan = wide._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan


def test_repeated_names_and_empty_tables(spark, tmp_path):
    twice = "<table><tr><th>A</th><th>A_2</th><th>A</th></tr><tr><td>1</td><td>2</td><td>3.5</td></tr><tr><td>4</td><td>5</td></tr></table>"
    tables = [("t", twice), ("bare", "<table><tr><th>h</th></tr></table>"), ("none", "no table")]
    parsed = H.parsed_tables(spark.createDataFrame(tables, "id string, html string"))
    assert list(parsed.where("id = 't'").first().headers) == ["A", "A_2", "A_2"]
    path = str(tmp_path / "typed")
    H.write_typed_tables(parsed, ["id"], path)
    stored = spark.read.parquet(path)
    assert [tuple(r) for r in H.widened(stored, ["id"], [("A", "long"), ("A_2", "double")]).orderBy("row").collect()] == [("t", 0, 1, 3.5), ("t", 1, 4, None)]
    heads = {r.id: (list(r.columns), r.row_count) for r in stored.where("row is null").collect()}
    assert heads == {"t": (["A", "A_2"], 2), "bare": ([], 0), "none": ([], 0)}


def test_failed_tables_keep_their_number(spark):
    cols = "id string, document_id string, page_no int, block_type string, text string, bbox_norm array<double>, image_path string, reading_order int, meta struct<table_body:string>"
    rows = [
        ("c", "d", 2, "text", "表 3 data\n<table><tr><th>a</th></tr><tr><td>1</td></tr></table>", None, None, 0, (None,)),
        ("a", "d", 1, "table", "a picture of a table", None, None, 5, ("<table><tr><th>q</th></tr></table>",)),
        ("b", "d", 1, "text", "plain", None, None, 6, (None,)),
    ]
    got = {r.provenance.block_id: r for r in extract_tables(spark.createDataFrame(rows, cols)).collect()}
    assert {k: r.table_id for k, r in got.items()} == {"a": "table_000001", "c": "table_000002"}
    assert got["c"].payload.table_title == "表 3 data" and [m.field for m in got["c"].validation.missing] == ["table_description"]
    assert list(got["a"].validation.columns) == ["q"] and got["a"].validation.row_count == 0


def test_character_references(spark):
    cells = ["80 &deg;C &#8451; &plusmn; &#x3b1;", "a&amp;lt;b &nbsp; c", "&#0; &#xD800; &#1114112;", "&none; & R&D; x;", "&#39;&apos;&quot;", "&#x1F600;", "", None]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cells)], "i int, c string")
    got = [r[0] for r in df.orderBy("i").select(H.cell_text(F.col("c"))).collect()]
    assert got == ["80 °C ℃ ± α", "a&lt;b c", "\ufffd \ufffd \ufffd", "&none; & R&D; x;", "''\"", "😀", "", None]


def test_json_default(spark):
    df = spark.createDataFrame([('{"a":1}',), ("",), (None,), ("oops",), ("[2]",)], "j string")
    got = [r.v.a for r in df.select(ST.json_or_default(F.col("j"), "struct<a:int>", "{}").alias("v")).collect()]
    assert got == [1, None, None, None, None]


def test_replace_rows(spark, tmp_path):
    path = str(tmp_path / "blocks")
    old = spark.createDataFrame([(f"d{i}", j) for i in range(12) for j in range(3)], "document_id string, n int")
    ST.write_bucketed(old, path, buckets=4)
    new = spark.createDataFrame([("d1", 100), ("new", 7)], "document_id string, n int")
    ST.replace_rows(spark, path, new, buckets=4)
    rows = sorted((r.document_id, r.n) for r in ST.read_bucketed(spark, path).collect())
    assert [n for d, n in rows if d == "d1"] == [100] and ("new", 7) in rows and len(rows) == 11 * 3 + 2
    plan = ST.touched(ST.read_bucketed(spark, path), new, buckets=4)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*bucket#\d+ (IN|=|INSET) ", plan)
    # Documents replaced by nothing vanish, even when that empties a bucket.
    ids = spark.createDataFrame([(d,) for d in sorted({d for d, _ in rows})[1:]], "document_id string")
    ST.replace_rows(spark, path, new.limit(0), documents=ids, buckets=4)
    assert {r.document_id for r in ST.read_bucketed(spark, path).collect()} == {"d0"}


def files(spark, tmp_path, contents):
    for name, body in contents.items():
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(body)
    return FS.hashed_files(FS.scan_files(spark, str(tmp_path)))


def test_intake_twice_adds_nothing(spark, tmp_path):
    hashed = files(spark, tmp_path, {"a.pdf": b"one", "sub/b.PDF": b"one", "c.pdf": b"two", "d.txt": b"three"})
    empty = hashed.limit(0).select("sha256")
    first = FS.intake_by_hash(hashed, empty)
    assert sorted(r.filename for r in first.collect()) == ["a.pdf", "c.pdf"]
    assert FS.intake_by_hash(hashed, first).count() == 0
    assert first.first().id == first.first().sha256
    whole = FS.intake_result(hashed, first)
    assert whole.count() == 2


def reactions(spark):
    payload = "struct<reaction_text:string,reaction_smiles:string,atom_mapped_reaction_smiles:string,reaction_latex:string,rxn_path:string,conditions:struct<catalyst:string,temperature_c:double,time_h:double>,yield_percent:double>"
    rows = []
    for i, status in enumerate(["pending", "approved", "edited", "uncertain", "rejected", "approved"]):
        p = (f"text {i}", None, None, None, f"r/{i}.rxn", (None, float(i), None), None)
        rows.append((f"r{i}", "d" if i < 5 else "e", p, (1, [0.0], f"{i}a"), (True,), status, f"2024-01-0{9 - i} 00:00:00"))
    df = spark.createDataFrame(
        rows,
        f"id string, document_id string, payload {payload}, provenance struct<page_no:int,bbox:array<double>,entry_label:string>, validation struct<schema_valid:boolean>, review_status string, t string",
    )
    return df.withColumn("created_at", F.col("t").cast("timestamp")).drop("t")


def test_json_export_files(spark, tmp_path):
    path = str(tmp_path / "out")
    R.write_text_export(R.export_json(reactions(spark), include_pending=True), path, per_document=True)
    body = "".join(open(f).read() for f in sorted(glob.glob(f"{path}/document_id=d/part-*")))
    got = json.loads(body)
    assert [x["reaction_text"] for x in got] == ["text 3", "text 2", "text 1", "text 0"]
    assert got[0]["conditions"] == {"catalyst": None, "temperature_c": 3.0, "time_h": None} and got[0]["yield_percent"] is None
    R.write_text_export(R.export_jsonl(reactions(spark)), str(tmp_path / "lines"), per_document=True)
    lines = "".join(open(f).read() for f in sorted(glob.glob(f"{tmp_path}/lines/document_id=d/part-*")))
    assert [json.loads(x)["reaction_text"] for x in lines.splitlines()] == ["text 2", "text 1"] and lines.endswith("\n")


def test_rxn_export(spark):
    bodies = spark.createDataFrame([("d", f"r/{i}.rxn", f" body {i}\n") for i in (1, 2)], "document_id string, rxn_path string, body string")
    pieces = R.export_rxn_text(reactions(spark), bodies).orderBy("created_at").collect()
    assert "".join(p.piece for p in pieces) == "body 2\n\n$$$$\n\nbody 1"


def test_variant_payload_is_projected(spark):
    df = reactions(spark).withColumn("payload", F.parse_json(F.lit('{"reaction_text":"x","zzz":1,"conditions":{"temperature_c":"80"},"yield_percent":"bad"}')))
    v = json.loads(R.export_jsonl(df).first().value)
    assert v["reaction_text"] == "x" and "zzz" not in v and v["conditions"]["temperature_c"] == 80.0 and v["yield_percent"] is None


def test_patches(spark):
    df = reactions(spark)
    null = F.lit(None).cast(df.schema["payload"].dataType)
    p = df.filter("id in ('r0', 'r1', 'r2')").withColumn("payload", F.col("payload").withField("reaction_text", F.lit("edit")))

    def patch(i, seq, payload, status):
        base = p.filter(F.col("id") == i)
        return base.select(F.lit(seq).cast("bigint").alias("seq"), F.col("id").alias("reaction_id"), (F.col("payload") if payload else null).alias("payload"), F.lit(status).cast("string").alias("review_status"))

    patches = patch("r0", 1, True, None).unionByName(patch("r0", 2, False, "rejected"))
    patches = patches.unionByName(patch("r1", 3, False, "uncertain")).unionByName(patch("r1", 4, True, None)).unionByName(patch("r2", 5, True, "approved"))
    out = R.apply_patches(df, R.fold_patches(patches))
    got = {r.id: (r.payload.reaction_text, r.review_status) for r in out.collect()}
    assert got["r0"] == ("edit", "rejected") and got["r1"] == ("edit", "edited") and got["r2"] == ("edit", "approved")
    assert got["r3"] == ("text 3", "uncertain")


def test_envelope_keeps_nulls_and_all_statuses(spark):
    env = R.review_envelope(reactions(spark), "reaction.v1")
    assert env.count() == 6 and env.columns[0] == "reaction_text" and env.columns[-1] == "provenance"
    line = env.select(F.to_json(F.struct("*"), R.KEEP_NULLS).alias("j")).first().j
    assert json.loads(line)["reaction_smiles"] is None


def test_update_document(spark):
    docs = spark.createDataFrame([("a", "f.pdf", "s", 3, "parsing", "busy", "c", "u"), ("b", "g.pdf", "t", 4, "uploaded", None, "c", "u")], "id string, filename string, sha256 string, page_count int, parse_status string, parse_error string, created_at string, updated_at string")
    patch = spark.createDataFrame([("a", "completed", True)], "id string, parse_status string, clear_error boolean")
    got = {r.id: r for r in C.update_document(docs, patch, F.lit("now")).collect()}
    assert (got["a"].parse_status, got["a"].parse_error, got["a"].updated_at, got["a"].filename, got["a"].created_at) == ("completed", None, "now", "f.pdf", "c")
    assert got["b"].updated_at == "u"


def test_json_arrays_of_all_documents(spark):
    lines = spark.createDataFrame([("d", 1, "a", "1"), ("d", 2, "b", "2"), ("d", 3, "c", "3"), ("e", 1, "z", "9")], "document_id string, created_at int, id string, value string")
    documents = spark.createDataFrame([("d",), ("e",), ("empty",)], "id string")
    parts = {}
    for r in R.json_array_lines(lines, documents).orderBy("document_id", "created_at", "id").collect():
        parts[r.document_id] = parts.get(r.document_id, "") + r.value
    assert parts == {"d": "[1,2,3]", "e": "[9]", "empty": "[]"}


def test_tables_are_read_in_as_many_tasks_as_partitions(spark):
    """Small tables are not joined into one task for their few bytes."""
    from leafmill.plans.extract import extract_tables

    html = "<table><tr><th>A</th></tr><tr><td>1</td></tr></table>"
    rows = [(f"b{i}", f"d{i % 7}", i, "table", html, [0.1, 0.1, 0.2, 0.2], None, 0, (None,)) for i in range(200)]
    df = spark.createDataFrame(rows, "id string, document_id string, page_no int, block_type string, text string, bbox_norm array<double>, image_path string, reading_order int, meta struct<table_body:string>")
    out = extract_tables(df)
    assert out.count() == 200
    assert out.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
