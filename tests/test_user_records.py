"""Records shaped by a user's example, on hand-worked rows."""

import json

import pytest
from pyspark.sql import functions as F

from leafmill.functions import example_schema as S
from leafmill.operators import candidates as K
from leafmill.operators import records as R
from leafmill.operators import user_records as U
from leafmill.plans.extract import ORDER, extract_for_example, extract_reactions
from leafmill.session import materialize

BLOCKS = "id string, document_id string, page_no int, block_type string, text string, bbox_norm array<double>, image_path string, reading_order int"
EXAMPLE = {"reaction_text": "", "sample": {"site": "", "depths": [1.5]}, "yield_percent": None, "reaction_smiles": {"left": ""}}


@pytest.fixture(scope="module")
def blocks(spark):
    page = "General conditions: Fe, 40 °C, 3 h stirring\n5a 20%\n5b 30.5%\nCC.O>>CCO"
    rows = [("b1", "d", 1, "text", page, [0.0, 0.0, 1.0, 1.0], None, 0), ("b2", "d", 2, "image", "Scheme 1", [0.0, 0.0, 1.0, 1.0], "i.png", 0), ("b3", "d", 7, "text", "yields 5c 1%\n5d 2%", [0.0, 0.0, 1.0, 1.0], None, 0)]
    return spark.createDataFrame(rows, BLOCKS)


def payloads(df):
    return [json.loads(r[0]) for r in df.orderBy(*ORDER).select(F.to_json("payload")).collect()]


def test_default_example_gives_the_default_records(blocks):
    one = extract_reactions(blocks).orderBy(*ORDER).collect()
    two = extract_for_example(blocks, S.DEFAULT_REACTION_EXAMPLE).orderBy(*ORDER)
    assert len(one) == 4
    for r, p in zip(one, payloads(two), strict=True):
        assert json.loads(json.dumps(r.payload.asDict(recursive=True))) == p
    assert [r.fingerprint for r in one] == [r.fingerprint for r in two.collect()]
    missing = [[m.field for m in r.validation.missing] for r in two.collect()]
    assert missing == [[m.field for m in r.validation.missing] for r in one]


def test_array_leaves_without_answer_fail(blocks):
    rows = extract_for_example(blocks, EXAMPLE).orderBy(*ORDER)
    got = rows.collect()
    assert [r.validation.status for r in got] == ["validation_failed"] * 4
    assert got[0].validation.schema_errors == ['sample.depths expected "array", got null']
    first = payloads(rows)[0]
    assert first["sample"] == {"site": None, "depths": None} and first["yield_percent"] == 20
    # An example may use a known key for an object; the known text does not overwrite it.
    assert first["reaction_smiles"] == {"left": None} and first["reaction_text"].startswith("Substrate entry 5a")


def test_answer_figure_mapping_and_scope(spark, blocks):
    good = json.dumps({"reaction_text": "given → made", "sample": {"site": "x", "depths": [1, "2.5", None]}, "yield_percent": 20, "reaction_smiles": {"left": "C"}})
    seen = json.dumps({"reaction_text": "seen → made", "sample": {"site": None, "depths": []}, "yield_percent": None, "reaction_smiles": {"left": None}})
    answers = spark.createDataFrame([("d", i, 1, good) for i in range(3)], "document_id string, candidate_index bigint, attempt int, answer_text string")
    figures = spark.createDataFrame([("d", i, seen) for i in range(3)], "document_id string, candidate_index bigint, answer_text string")
    documents = spark.createDataFrame([("d", 2), ("e", 5)], "id string, page_count int")
    rows = extract_for_example(blocks, EXAMPLE, documents, answers, figures).orderBy(*ORDER)
    got, values = rows.collect(), payloads(rows)
    assert [r.page_no for r in got] == [1, 1, 2]  # page 7 lies beyond the catalogued pages
    assert [v["reaction_text"] for v in values] == ["given → made", "given → made", "seen → made"]  # a figure is read for schemes only
    assert values[0]["sample"]["depths"] == [1, 2.5, None] and values[1]["yield_percent"] == 30.5
    assert all(r.validation.schema_valid and r.validation.status is None for r in got)
    assert extract_for_example(blocks, EXAMPLE, spark.createDataFrame([("d", 0)], "id string, page_count int")).select("page_no").distinct().collect()[0][0] == 1


def test_mapper_reason(spark):
    c = spark.createDataFrame([("d", 1, 0, "CC>>O", "[C:1]>>[C:1]", None), ("d", 2, 0, "CC>>O", None, "no_template"), ("d", 3, 0, "CC>>", None, None), ("d", 4, 0, "none", "[C:1]>>[C:1]", "x")],
                              "document_id string, page_no int, entry_no int, source_text string, mapped_smiles string, mapping_reason string")
    c = c.selectExpr("*", "'text' as source_type", "cast(null as string) as entry_label", "cast(null as double) as yield_percent", "cast(null as struct<catalyst:string,temperature_c:double,time_h:double>) as inherited_conditions", "'m' as mapper", "'1' as mapper_version")
    rows = U.enrich_user_record(c, S.DEFAULT_REACTION_EXAMPLE).orderBy("page_no").collect()
    why = [[(m.field, m.missing_reason) for m in r.validation.missing if m.missing_reason != "source_not_present"] for r in rows]
    mapped = "atom_mapped_reaction_smiles"
    assert why == [[], [(mapped, "no_template")], [(mapped, "extraction_failed")], [(mapped, "extraction_failed")]]
    assert [r.payload[mapped] for r in rows] == ["[C:1]>>[C:1]", None, None, None]
    assert [r.validation.mapper for r in rows] == ["m", "m", None, None]


def test_saved_ids_repeat(spark, blocks):
    at = F.lit("2024-01-01").cast("timestamp")
    one = U.saved(extract_for_example(blocks, EXAMPLE), "run-1", at).collect()
    two = U.saved(extract_for_example(blocks, EXAMPLE), "run-2").collect()
    assert {r.id for r in one} == {r.id for r in two} and len({r.id for r in one}) == 4
    assert {(r.review_status, r.run_id, str(r.created_at)) for r in one} == {("pending", "run-1", "2024-01-01 00:00:00")}
    stored = materialize(U.saved(extract_for_example(blocks, EXAMPLE)), "stored")
    assert extract_for_example(blocks, EXAMPLE, stored=stored).count() == 0


def test_submitted_records(spark):
    example = {"reaction_text": "", "yield_percent": 1.5, "tags": [""]}
    fits = {"reaction_text": "a", "yield_percent": 5, "tags": ["t"]}
    rows = [(1, fits), (2, fits), (3, {**fits, "tags": "t"}), (4, {**fits, "reaction_text": "b"}), (5, {**fits, "yield_percent": 6}), (6, {"reaction_text": "kept"} | {"yield_percent": None, "tags": []})]
    sent = spark.createDataFrame([("d", i, json.dumps(p), (1, "5 %")) for i, p in rows], "document_id string, seq long, j string, provenance struct<page_no:int,source_text:string>")
    sent = sent.withColumn("payload", F.parse_json("j")).drop("j")
    stored = spark.createDataFrame([("old", "d", '{"reaction_text":"kept"}', (1, ""))], "id string, document_id string, j string, provenance struct<page_no:int,source_text:string>")
    out = {r.seq: r for r in U.save_submitted(sent, stored.withColumn("payload", F.parse_json("j")).drop("j"), example).withColumn("payload", F.to_json("payload")).collect()}
    assert [out[i].saved for i in range(1, 7)] == [True, False, False, True, True, False]
    assert out[2].duplicate_of == out[1].id and out[6].duplicate_of == "old" and out[3].duplicate_of is None
    assert list(out[3].validation.schema_errors) == ['tags expected "array", got "t"'] and out[3].id is None
    assert json.loads(out[5].payload)["yield_percent"] is None  # 6 % is not in the evidence
    assert json.loads(out[1].payload)["tags"] == ["t"]


def test_export_in_the_examples_order(spark):
    j = '{"yield_percent":85.0,"sample":{"depths":[1.0,2.5],"site":"s"},"reaction_text":"t","more":1}'
    df = spark.createDataFrame([(j,), ("{}",)], "j string").withColumn("payload", F.parse_json("j"))
    got = [r[0] for r in df.select(U.projected_text(EXAMPLE, F.col("payload"))).collect()]
    assert got[0] == '{"reaction_text":"t","sample":{"site":"s","depths":[1,2.5]},"yield_percent":85,"reaction_smiles":null}'
    assert got[1] == '{"reaction_text":null,"sample":null,"yield_percent":null,"reaction_smiles":null}'


def test_known_fields_alone(blocks):
    found = R.known_fields(K.reaction_candidates(blocks)).orderBy("page_no", "entry_no")
    got = json.loads(found.select(F.to_json(U.fallback(U.user_schema({"conditions": {"solvent": "", "time_h": 1}, "n": 1})))).first()[0])
    assert got == {"conditions": {"catalyst": "Fe", "solvent": None, "temperature_c": 40, "time_h": 3}, "n": None}
    with pytest.raises(ValueError, match="object"):
        U.user_schema([1])


def test_submissions_are_judged_once(spark):
    """The schema's errors are found in a step of their own, which the joins read back."""
    rows = [("d", 1, '{"n":"x"}', (1, "")), ("d", 2, '{"n":5}', (1, "5 %"))]
    sent = spark.createDataFrame(rows, "document_id string, seq long, j string, provenance struct<page_no:int,source_text:string>").withColumn("payload", F.parse_json("j")).drop("j")
    out = U.save_submitted(sent, sent.where("seq < 0").withColumn("id", F.lit("s")), {"n": 1.5})
    assert [r.saved for r in out.orderBy("seq").collect()] == [False, True]
    assert " expected " not in out._jdf.queryExecution().optimizedPlan().toString()


def test_fallback_is_judged_once(blocks, monkeypatch):
    """Candidates without any answer have one value to judge; null answers give the same records."""
    asked, check = [], U.S.validate
    monkeypatch.setattr(U.S, "validate", lambda node, v: asked.append(str(v)) or check(node, v))
    found = K.reaction_candidates(blocks)
    alone = U.final_payload(U.enrich_user_record(found, EXAMPLE))
    assert len(asked) == 1 and "_told" in asked[0]
    nulls = found.withColumns({c: F.lit(None).cast("variant") for c in ("answer", "repair")})
    both = [
        sorted((r.page_no, r.entry_no, r.payload, r.validation) for r in df.select("page_no", "entry_no", F.to_json("payload").alias("payload"), F.to_json("validation").alias("validation")).collect())
        for df in (alone, U.final_payload(U.enrich_user_record(nulls, EXAMPLE)))
    ]
    assert both[0] == both[1] and both[0]


def test_typed_judging_equals_variant_judging(spark):
    """Known fields judged as they are typed give what their variant gives, whatever the example makes of them."""
    texts = ["85", "null", "a → b", "1e3", None, "CC>>O", " 7 "]
    cols = "document_id string, page_no int, entry_no int, known_text string, known_smiles string, known_latex string, yield_percent double, inherited_conditions struct<catalyst:string,temperature_c:double,time_h:double>"
    rows = [("d", i, j, t, texts[-1 - i], texts[j], y, c) for i, t in enumerate(texts) for j, (y, c) in enumerate([(None, None), (64.0, ("null", 80.0, None)), (31.5, ("12", -0.0, 2.5)), (-0.0, ("Pd", None, 1e20))])]
    found = spark.createDataFrame(rows, cols).selectExpr("*", "'text' as source_type", "cast(null as string) as entry_label", "known_text as whole_text").cache()
    odd = [
        {"reaction_text": None, "reaction_latex": 1, "reaction_smiles": True, "tags": [""], "yield_percent": "", "conditions": {"catalyst": 1.5, "temperature_c": "", "time_h": [1]}},
        {"reaction_text": [""], "reaction_latex": "", "yield_percent": None, "conditions": {"catalyst": "", "temperature_c": {"at": 1}, "more": None}, "solvent": {"name": "", "parts": {"a": [1]}}},
        {"reaction_smiles": {"left": ""}, "yield_percent": True, "conditions": "", "n": None},
        {"yield_percent": {"low": 1}, "reaction_text": ""},
    ]
    for example in odd:
        nulls = found.withColumns({c: F.lit(None).cast("variant") for c in ("answer", "repair")})
        one, two = (
            sorted(
                (r.page_no, r.entry_no, r.j, r.p, r.validation)
                for r in U.final_payload(U.enrich_user_record(df, example).withColumn("p", F.to_json("payload"))).select("page_no", "entry_no", F.to_json("payload").alias("j"), "p", F.to_json("validation").alias("validation")).collect()
            )
            for df in (found, nulls)
        )
        assert one == two and len(one) == 28, example


def test_a_rerun_makes_no_record_of_a_stored_one(spark, blocks):
    """Records without answer are made after the choice by identity; the identity is the one of the whole record."""
    example = {"reaction_text": "", "yield_percent": "", "solvent": {"name": "", "parts": [1]}}
    first = extract_for_example(blocks, example)
    stored = materialize(U.saved(first.filter("page_no < 7")), "stored")
    again = extract_for_example(blocks, example, stored=stored)
    assert sorted((r.page_no, r.fingerprint) for r in again.collect()) == sorted((r.page_no, r.fingerprint) for r in first.collect() if r.page_no == 7)
    whole = R.with_fingerprint(U.stored_core(first))
    assert sorted((r.page_no, r.fingerprint) for r in whole.collect()) == sorted((r.page_no, r.fingerprint) for r in first.collect())
    plan = again._jdf.queryExecution().optimizedPlan().toString().splitlines()
    chosen = next(i for i, line in enumerate(plan) if "Window" in line)
    assert any("to_variant_object" in line for line in plan[:chosen])
    assert not any("to_variant_object" in line for line in plan[chosen:])
