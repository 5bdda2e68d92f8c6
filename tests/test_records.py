"""Candidates, validation, rules and de-duplication on hand-worked rows."""

import json
import re

import pytest
from pyspark.sql import functions as F

from leafmill.functions import example_schema as S
from leafmill.functions import text as X
from leafmill.operators import candidates as K
from leafmill.operators import records as R
from leafmill.plans.extract import ORDER, extract_reactions, extract_records

# A run sheet with six entries and shared conditions, and a page of plain prose.
SHEET = (
    "7f  31.5 %\n7g 64%\n7h\t8 %\n12a 90%\n12b 77.25%\n12c 3%\n"
    "一般条件：CuI, 110 ℃, 18.5 h under argon\n"
    "Nc1ccccc1.Brc1ccncc1>>c1ccc(Nc2ccncc2)cc1\n"
    "$$\\mathrm{ArNH_2 + PyBr \\rightarrow ArNHPy}$$"
)
PROSE = "Weighing and washing are described elsewhere.\nThe crude yield, 64%, was not corrected."
SHARES = {"7f": 31.5, "7g": 64.0, "7h": 8.0, "12a": 90.0, "12b": 77.25, "12c": 3.0}

BLOCKS = "id string, document_id string, page_no int, block_type string, text string, bbox_norm array<double>, image_path string, reading_order int"


def block(i, page, text, kind="text", order=0, box=(0.1, 0.1, 0.5, 0.5), image=None):
    return (f"b{i}", "d", page, kind, text, list(box), image, order)


@pytest.fixture(scope="module")
def demo(spark):
    return spark.createDataFrame([block(1, 4, SHEET), block(2, 9, PROSE)], BLOCKS)


def test_demo_candidates(demo):
    rows = K.candidate_index(K.reaction_candidates(demo)).orderBy("candidate_index").collect()
    assert [(r.entry_label, r.yield_percent) for r in rows] == [*SHARES.items(), (None, None)]
    c = rows[0].inherited_conditions
    assert (c.catalyst, c.temperature_c, c.time_h) == ("CuI", 110.0, 18.5)
    assert [r.source_type for r in rows] == ["scheme_entry"] * 6 + ["text"]


def test_demo_extraction_and_rerun(demo):
    first = extract_reactions(demo)
    rows = first.orderBy("page_no", "entry_no").collect()
    assert {r.payload.reaction_smiles for r in rows} == {"Nc1ccccc1.Brc1ccncc1>>c1ccc(Nc2ccncc2)cc1"}
    assert [r.payload.yield_percent for r in rows] == list(SHARES.values())
    assert [r.payload.reaction_text.split()[2] for r in rows] == list(SHARES)
    assert all(r.payload.reaction_latex.startswith("$$") for r in rows)
    assert extract_reactions(demo, stored=first).count() == 0


def test_two_images_and_boxes(spark):
    rows = [
        block(1, 1, "nothing here", order=0, box=(0.0, 0.0, 0.1, 0.1)),
        block(2, 1, None, kind="image", order=1, box=(0.3, 0.2, 0.6, 0.5), image="i.png"),
        block(3, 1, "the yield was low", order=2, box=(0.2, 0.4, 0.5, 0.9)),
        block(4, 2, "plain", order=0),
    ]
    got = K.reaction_candidates(spark.createDataFrame(rows, BLOCKS)).collect()
    assert len(got) == 1
    r = got[0]
    assert (r.source_type, r.image_path, list(r.block_ids)) == ("reaction_scheme", "i.png", ["b2", "b3"])
    assert list(r.bbox) == [0.2, 0.2, 0.6, 0.9]
    assert r.source_text == "\nthe yield was low"


def conditions_of(spark, text):
    df = spark.createDataFrame([(text,)], "t string")
    return df.select(K.page_conditions(F.col("t")).alias("c")).first().c


def test_conditions_beside_cjk(spark):
    c = conditions_of(spark, "反应条件：催化剂Pd(OAc)2在100 ℃反应2 h后处理")
    assert (c.temperature_c, c.time_h) == (100.0, 2.0)
    assert conditions_of(spark, "no line") is None
    assert conditions_of(spark, "general conditions: abc") is None


def test_entries_touching_percent(spark):
    df = spark.createDataFrame([("1a 10%2b 20.5 % x3c 5% 12 d\n7%",)], "t string")
    e = df.select(K.scheme_entries(F.col("t")).alias("e")).first().e
    assert [(x.label, x.yield_percent) for x in e] == [("1a", 10.0), ("2b", 20.5), ("12d", 7.0)]


def checked(spark, example, value):
    df = spark.createDataFrame([(None if value is None else json.dumps(value),)], "j string")
    node = S.schema_from_example(example)
    r = df.select(S.validate(node, F.try_parse_json("j")).alias("c")).first().c
    return r.value, list(r.errors), [m.field for m in r.missing]


def test_validate_golden(spark):
    ex = {"a": "", "n": 1}
    v, e, m = checked(spark, ex, {"a": "", "n": "7", "z": 1})
    assert (v.a, v.n, e, m) == (None, 7.0, [], ["a"])
    _, e, _ = checked(spark, ex, {"a": "x"})
    assert e == ['n expected ["integer","null"], got undefined']
    v, e, m = checked(spark, ex, {"a": "null", "n": None})
    assert (e, m) == ([], ["a", "n"])
    _, e, _ = checked(spark, ex, None)
    assert e == ['$ expected "object", got undefined']
    v, e, _ = checked(spark, ex, {"a": 5, "n": 1.5})
    assert v.n == 1.5 and e == ['a expected ["string","null"], got 5']


def test_validate_nested(spark):
    ex = {"o": {"x": None, "tags": [{"k": ""}]}, "flag": True}
    v, e, m = checked(spark, ex, {"o": {"x": 3.0, "tags": [{"k": "v"}, {"k": ""}, 4]}, "flag": "yes"})
    assert v.o.x == "3" and [t and t.k for t in v.o.tags] == ["v", None, None]
    assert e == ['o.tags[2] expected "object", got 4', 'flag expected ["boolean","null"], got "yes"']
    assert m == ["o.tags[1].k"]
    v, e, m = checked(spark, ex, {"o": None, "flag": None})
    assert e == ['o expected "object", got null'] and v.o is None and m == ["flag"]


def ruled(spark, share, source, mapped=None):
    df = spark.createDataFrame([(1,)], "i int").select(
        F.struct(
            *[F.lit(None).cast("string").alias(c) for c in ("reaction_text", "reaction_smiles")],
            F.lit(mapped).cast("string").alias("atom_mapped_reaction_smiles"),
            *[F.lit(None).cast("string").alias(c) for c in ("reaction_latex", "rxn_path")],
            F.lit(None).cast("struct<catalyst:string,temperature_c:double,time_h:double>").alias("conditions"),
            F.lit(None).cast("double").alias("yield_percent"),
        ).alias("payload"),
        F.struct(F.lit(source).alias("source_text")).alias("provenance"),
        F.lit(share).cast("string").alias("y"),
    )
    r = R.evidence_rules(df, "y").first()
    return r.payload.yield_percent, {m.field: m.missing_reason for m in r.rule_missing}


@pytest.mark.parametrize(
    ("share", "source", "want", "why"),
    [
        ("85", "about 85% of it", 85.0, None),
        ("85", "185%", None, "source_not_present"),
        ("85", "85.0%", None, "source_not_present"),
        ("85", "1.85 %", None, "source_not_present"),
        ("85.5", "(85.5 %)", 85.5, None),
        ("-5", "was -5%", -5.0, None),
        ("-5", "was 5%", None, "source_not_present"),
        ("abc", "abc%", None, "extraction_failed"),
        ("", "85%", None, "source_not_present"),
        (None, "85%", None, "source_not_present"),
    ],
)
def test_yield_evidence(spark, share, source, want, why):
    got, missing = ruled(spark, share, source)
    assert got == want and missing.get("yield_percent") == why
    assert missing["atom_mapped_reaction_smiles"] == "extraction_failed"


def test_number_text(spark):
    values = [85.0, 85.5, 0.5, 1e7, 12345678.25, 0.0001, 1e-05, -3.0, 100.0, 1e300]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    got = [r.t for r in df.select(X.number_text(F.col("x")).alias("t")).collect()]
    assert got == ["85", "85.5", "0.5", "10000000", "12345678.25", "0.0001", "0.00001", "-3", "100", "1.0E300"]


def test_participants(spark):
    rows = [(1, "CCO.CC(=O)O>>CC(=O)OCC.O"), (2, "A>B>>C"), (3, "A>B>C"), (4, ">>C"), (5, " A..B>> C "), (6, "A>>B>>C"), (7, "A>>>B"), (8, None)]
    df = spark.createDataFrame(rows, "id int, smiles string")
    got = {}
    for r in R.reaction_participants(df).collect():
        got.setdefault(r.id, {}).setdefault(r.role, {})[r.position] = r.smiles
    flat = {i: {role: [p[k] for k in sorted(p)] for role, p in v.items()} for i, v in got.items()}
    assert {k: len(v) for k, v in flat[1].items()} == {"reactant": 2, "product": 2}
    assert flat[2] == {"reactant": ["A"], "agent": ["B"], "product": ["C"]}
    assert 3 not in flat and 4 not in flat and 8 not in flat
    assert flat[5] == {"reactant": ["A", "B"], "product": ["C"]}
    assert flat[6] == {"reactant": ["A"], "product": ["B>>C"]}
    assert flat[7] == {"reactant": ["A"], "product": [">B"]}
    errs = {r.id: r.e for r in df.select("id", X.reaction_syntax_error(F.col("smiles")).alias("e")).collect()}
    assert errs[8] == "empty_reaction_smiles" and errs[2] is None and errs[3].startswith("reaction_smiles_must")


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ('x ```json\n{"a": 1}\n``` y {"a": 2}', 1),
        ('say {"a": 3} ok', 3),
        ("```\n```", None),
        ("no json", None),
        ('{"a": {"b": 1}', None),
        ("} {", None),
    ],
)
def test_loose_json(spark, text, want):
    v = spark.createDataFrame([(text,)], "t string").select(X.loose_json(F.col("t")).alias("v"))
    assert v.select(F.try_variant_get("v", "$.a", "int").alias("a")).first().a == want


def test_same_page_duplicates(demo, spark):
    # The same page given twice as blocks yields each record once.
    c = K.reaction_candidates(demo)
    again = c.unionByName(c.withColumn("entry_no", F.col("entry_no") + 100))
    got = extract_records(again)
    assert got.count() == len(SHARES) and got.agg(F.max("entry_no")).first()[0] < 100


def test_missing_union_keeps_first(spark):
    df = spark.range(1).select(
        R.missing_entry("a", "x").alias("e"), F.concat(R.missing_entry("a", "y"), R.missing_entry("b", "z")).alias("n")
    )
    got = df.select(R.missing_union(F.col("e"), F.col("n")).alias("m")).first().m
    assert [(m.field, m.missing_reason) for m in got] == [("a", "x"), ("b", "z")]


def test_order_columns():
    assert ORDER == ["page_no", "entry_no"]


def test_whole_texts_are_read(spark):
    """Facts far down a long page count: SMILES, LaTeX, conditions, yields."""
    filler = "plain words of a long page\n" * 400
    page = filler + "General conditions: " + "x " * 300 + "catalyst H2SO4, 80 °C, 2 h\nCCO>>CCOC\n3a 85%\n3b 7%"
    df = spark.createDataFrame([block(1, 1, page)], BLOCKS)
    rows = K.reaction_candidates(df).orderBy("entry_no").collect()
    assert [r.inherited_conditions.temperature_c for r in rows] == [80.0, 80.0] and rows[0].source_text == page
    out = extract_reactions(df).orderBy("entry_no").collect()
    assert [r.payload.yield_percent for r in out] == [85.0, 7.0] and out[0].payload.reaction_smiles == "CCO>>CCOC"


def test_long_reaction_texts_end(spark):
    """Texts of 100,000 characters are judged in linear time."""
    n = 100_000
    texts = ["C" * n, "." * n + ">>" + "." * n, "C" * n + ">>" + "N" * n, "C>" * n, "a.b>c.d>>e.f", "a>>", ">>b", "a>>b"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, smiles string")
    got = [r[0] for r in df.orderBy("id").select(X.is_reaction(F.col("smiles"))).collect()]
    assert got == [False, False, True, False, True, False, False, True]
    parts = [(r.role, r.position, r.smiles) for r in R.reaction_participants(df.where("id = 4")).collect()]
    assert sorted(parts) == [("agent", 0, "c"), ("agent", 1, "d"), ("product", 0, "e"), ("product", 1, "f"), ("reactant", 0, "a"), ("reactant", 1, "b")]


def test_tiny_numbers_keep_their_digits(spark):
    df = spark.createDataFrame([(1e-13,), (1.5e-5,), (85.0,), (0.5,), (12345678.25,)], "x double")
    assert [r[0] for r in df.select(X.number_text(F.col("x"))).collect()] == ["0.0000000000001", "0.000015", "85", "0.5", "12345678.25"]


def test_late_success_settles_a_window(spark):
    from leafmill.operators import windows as W

    chunks = spark.createDataFrame([("d", 1, None, None)], "document_id string, chunk_ord int, status string, error string")
    tries = spark.createDataFrame([("d", 1, 1, False, "a"), ("d", 1, 2, False, "b"), ("d", 1, 3, True, None)], "document_id string, chunk_ord int, attempt int, ok boolean, error string")
    assert [r.status for r in W.settle_attempts(chunks, tries).collect()] == ["completed"]


def test_sorts_hold_keys_only(demo):
    """No sort of an extraction, before or after its evidence is joined, moves page text."""
    plan = extract_reactions(demo)._jdf.queryExecution().explainString(demo.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    sorts = re.findall(r"\(\d+\) Sort\n(?:Input \[\d+\]: (.*))", plan)
    assert sorts and not [s for s in sorts if "source_text" in s or "block_ids" in s]
    assert "ShuffledHashJoin" in plan


def test_percents_are_read_once(spark):
    texts = ["a 5% b 5 % c -7% d 3-8% .5% 1.50% 10 percent", "", None, "no sign", "-0.5%"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(X.percents(F.col("t"))).collect()]
    assert got == [["5", "7", "8", ".5", "1.50", "-7"], [], [], [], ["0.5", "-0.5"]]


def test_candidates_stay_on_their_page(demo):
    """Identities hold the page, so rows laid out by page are not dealt again for them."""
    df = extract_reactions(demo)
    assert df.count() == 6
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"Exchange hashpartitioning\([^)]*fingerprint", plan)


def test_stored_identities_meet_new_rows_on_their_page(demo, tmp_path):
    """Neither side of the check against stored records is dealt by whole identities; a rerun appends nothing."""
    spark, path = demo.sparkSession, str(tmp_path / "stored")
    whole = extract_reactions(demo)
    whole.filter("entry_no = 0").write.parquet(path)
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rest = extract_reactions(demo, stored=spark.read.parquet(path))
        assert sorted(r.fingerprint for r in rest.collect()) == sorted(r.fingerprint for r in whole.filter("entry_no > 0").collect())
        plan = rest._jdf.queryExecution().executedPlan().toString()
        assert not re.search(r"Exchange hashpartitioning\([^)]*fingerprint", plan)
        rest.write.mode("append").parquet(path)
        assert extract_reactions(demo, stored=spark.read.parquet(path)).count() == 0
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)


def test_parts_follow_what_a_task_holds(spark, monkeypatch):
    """One shuffle partition in the session, and yet no task hashes more evidence than it may hold."""
    from leafmill.plans import extract as P

    monkeypatch.setattr(P, "HASHED_BYTES", 2_000, raising=False)
    df = spark.createDataFrame([block(i, i, f"CCO>>CC{'C' * i}\n{SHEET}") for i in range(1, 41)], BLOCKS)
    held = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        out = extract_reactions(df)
        rows = out.select("page_no", "entry_no", "provenance", F.spark_partition_id().alias("part")).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", held)
    assert len(rows) == 240 and len({r.part for r in rows}) >= 8
    assert all(list(r.provenance.block_ids) == [f"b{r.page_no}"] for r in rows)
    assert {r.part for r in rows if r.page_no == 7} == {r.part for r in rows if r.page_no == 7 and r.entry_no == 0}


def test_patterns_of_a_page_run_once(demo):
    """What a pattern found is compared as a column; the plan holds each pattern once."""
    plan = R.source_facts(K.candidate_pages(demo, percents=True))._jdf.queryExecution().optimizedPlan().toString()
    assert [plan.count(p) for p in (X.CONDITION_LINE, X.CATALYST, X.SMILES_TOKEN, X.LATEX_SPAN)] == [1, 1, 1, 1]
