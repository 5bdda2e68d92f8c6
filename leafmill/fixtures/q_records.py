"""Queries: validation, enrichment, evidence, de-duplication and the whole extraction."""

from __future__ import annotations

from pyspark.sql import functions as F

from leafmill.fixtures import q_candidates  # noqa: F401  (registers the candidate views)
from leafmill.fixtures import views as D
from leafmill.fixtures.registry import query, view
from leafmill.functions import example_schema as S
from leafmill.functions import text as X
from leafmill.operators import candidates as K
from leafmill.operators import records as R
from leafmill.plans.extract import ORDER, extract_from_pages, extract_reactions, stored_pages
from leafmill.session import scratch_path


def pairs(c):
    """missing entries as text: field:reason,field:reason"""
    return F.array_join(F.transform(c, lambda m: F.concat(m["field"], F.lit(":"), m["missing_reason"])), ",")


# The oracle's forms of the patterns in functions/text.py.
HEAD = "nullif(array_to_string(list_filter(string_split(source_text, chr(10)), lambda x: x <> ''), ' '), '')"
SMILES = r"nullif(regexp_extract(source_text, '([A-Za-z0-9@+\-\[\]\(\)=#$\\/%\.]+>>[A-Za-z0-9@+\-\[\]\(\)=#$\\/%\.]+)', 1), '')"
LATEX = r"nullif(regexp_extract(source_text, '\$\$([\s\S]+?)\$\$|\\mathrm\{[\s\S]+?\}', 0), '')"

# Known-field fallback of each candidate.
view(
    "fallbacks",
    f"""
SELECT *, CASE WHEN entry_label IS NOT NULL THEN concat('Substrate entry ', entry_label, ' is converted to the corresponding product under the scheme conditions reported on page ', page_no, '.')
    ELSE {HEAD} END AS reaction_text, {SMILES} AS reaction_smiles, {LATEX} AS reaction_latex
FROM candidates
""",
)

# Records after keep and evidence rules.
view(
    "ruled",
    r"""
SELECT *, CASE WHEN seen THEN yield_percent END AS final_yield, concat_ws(',',
    CASE WHEN reaction_text IS NULL THEN 'reaction_text:source_not_present' END,
    CASE WHEN reaction_smiles IS NULL THEN 'reaction_smiles:source_not_present' END,
    'atom_mapped_reaction_smiles:source_not_present',
    CASE WHEN reaction_latex IS NULL THEN 'reaction_latex:source_not_present' END,
    'rxn_path:source_not_present',
    CASE WHEN catalyst IS NULL THEN 'conditions.catalyst:source_not_present' END,
    CASE WHEN temperature_c IS NULL THEN 'conditions.temperature_c:source_not_present' END,
    CASE WHEN time_h IS NULL THEN 'conditions.time_h:source_not_present' END,
    CASE WHEN yield_percent IS NULL THEN 'yield_percent:source_not_present' END,
    'atom_mapped_reaction_smiles:extraction_failed',
    CASE WHEN yield_percent IS NOT NULL AND NOT seen THEN 'yield_percent:source_not_present' END) AS missing
FROM (SELECT *, list_contains(regexp_extract_all(source_text, '([0-9.]+)\s*%', 1),
      CASE WHEN yield_percent = floor(yield_percent) THEN cast(cast(yield_percent AS bigint) AS varchar) ELSE cast(yield_percent AS varchar) END) AS seen
  FROM fallbacks
  WHERE contains(coalesce(reaction_smiles, ''), '>>') OR regexp_matches(coalesce(reaction_latex, ''), 'rightarrow|→|->') OR source_type = 'scheme_entry'
    OR regexp_matches(reaction_text, '(>>|→|->|生成.{2,40}|转化为|afford|gave |obtained)', 'i'))
""",
)

view(
    "extracted",
    """
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY document_id, reaction_smiles, reaction_text, page_no, final_yield ORDER BY page_no, entry_no) AS rn FROM ruled) WHERE rn = 1
""",
)


@query(
    "known_fields",
    "SELECT document_id, page_no, entry_no, reaction_text, reaction_smiles, reaction_latex, catalyst, temperature_c, time_h, yield_percent FROM fallbacks",
)
def _(spark, sf):
    c = K.reaction_candidates(D.entry_blocks(spark, sf))
    p = R.known_fields(c).withColumn("p", R.apply_known_fields(None))
    return p.select("document_id", "page_no", "entry_no", "p.reaction_text", "p.reaction_smiles", "p.reaction_latex", "p.conditions.*", "p.yield_percent")


def _records(df):
    p = F.col("payload")
    return df.select(
        "document_id", F.col("provenance.page_no").alias("page_no"), F.col("provenance.entry_label").alias("entry_label"),
        F.col("provenance.source_type").alias("source_type"), p["reaction_text"].alias("reaction_text"), p["reaction_smiles"].alias("reaction_smiles"),
        p["reaction_latex"].alias("reaction_latex"), "payload.conditions.*", p["yield_percent"].alias("yield_percent"),
        pairs(F.col("validation.missing")).alias("missing"),
    )


EXTRACTED = "SELECT document_id, page_no, entry_label, source_type, reaction_text, reaction_smiles, reaction_latex, catalyst, temperature_c, time_h, final_yield AS yield_percent, missing FROM extracted"


@query("extract_reactions", EXTRACTED)
def _(spark, sf):
    return _records(extract_reactions(D.entry_blocks(spark, sf)))


@query("append_reactions", EXTRACTED)
def _(spark, sf):
    # Early pages are stored first; the second pass over every page adds only the rest.
    path = scratch_path(spark, "reactions")
    pages = stored_pages(D.entry_blocks(spark, sf))
    extract_from_pages(pages.filter("page_no <= 20")).write.parquet(path)
    stored = spark.read.parquet(path)
    extract_from_pages(pages, stored=stored).write.mode("append").parquet(path)
    return _records(spark.read.parquet(path))


@query(
    "reaction_provenance",
    """
SELECT document_id, page_no, entry_no, source_type, source_text, image_path AS source_image_path, entry_label, block_ids,
  CASE WHEN page_no % 3 > 0 THEN 'atlas' END AS atom_mapper, CASE WHEN page_no % 3 > 0 THEN concat('v', entry_no) END AS atom_mapper_version FROM candidates
""",
)
def _(spark, sf):
    mapped = {"mapper": F.expr("case when page_no % 3 > 0 then 'atlas' end"), "version": F.expr("case when page_no % 3 > 0 then concat('v', entry_no) end")}
    c = K.reaction_candidates(D.entry_blocks(spark, sf)).withColumns(mapped).withColumn("p", R.reaction_provenance("mapper", "version"))
    return c.select(
        "document_id", "p.page_no", "entry_no", "p.source_type", "p.source_text", "p.source_image_path", "p.entry_label",
        F.array_join("p.block_ids", ",").alias("block_ids"), "p.atom_mapper", "p.atom_mapper_version",
    )


@query(
    "keep_reaction",
    "SELECT document_id, page_no, entry_no, reaction_text FROM ruled",
)
def _(spark, sf):
    c = K.reaction_candidates(D.entry_blocks(spark, sf))
    p = R.known_fields(c).withColumn("payload", R.apply_known_fields(None))
    return R.keep_reaction(p).select("document_id", "page_no", "entry_no", F.col("payload.reaction_text").alias("reaction_text"))


# ---- answers ------------------------------------------------------------------------
ANSWER_TEXT = HEAD.replace("source_text", "text")
ANSWER_SMILES, ANSWER_LATEX = SMILES.replace("source_text", "text"), LATEX.replace("source_text", "text")

view(
    "answer_values",
    f"""
SELECT *, CASE WHEN verdict = 'g' THEN 'A -> B ' || conv_id ELSE {ANSWER_TEXT} END AS reaction_text,
  CASE WHEN verdict = 'g' THEN CASE WHEN conv_id % 3 = 0 THEN NULL ELSE 'CC>>C' || turn END ELSE {ANSWER_SMILES} END AS reaction_smiles,
  {ANSWER_LATEX} AS reaction_latex,
  CASE WHEN verdict = 'g' THEN 80.0::double END AS temperature_c, CASE WHEN verdict = 'g' THEN 2.5::double END AS time_h,
  CASE WHEN verdict = 'g' THEN cast(conv_id % 100 AS double) END AS yield_percent
FROM answered
""",
)

UNFIT = (
    """'reaction_text expected ["string","null"], got 5;conditions.temperature_c expected ["number","null"], got "warm";"""
    """yield_percent expected ["number","null"], got undefined'"""
)


@query(
    "model_answers",
    f"""
SELECT document_id, candidate_index, reaction_text, reaction_smiles, reaction_latex, temperature_c, time_h, yield_percent, verdict <> 'f' AS schema_valid,
  CASE WHEN verdict = 'f' THEN {UNFIT} ELSE '' END AS errors,
  CASE verdict WHEN 'g' THEN 'reaction_latex:source_not_present,rxn_path:source_not_present,conditions.catalyst:source_not_present'
      || CASE WHEN conv_id % 3 = 0 THEN ',reaction_smiles:extraction_failed' ELSE '' END
    WHEN 'f' THEN 'reaction_smiles:source_not_present,atom_mapped_reaction_smiles:source_not_present,reaction_latex:source_not_present,rxn_path:source_not_present,conditions.time_h:source_not_present'
    ELSE concat_ws(',', CASE WHEN reaction_text IS NULL THEN 'reaction_text:source_not_present' END, CASE WHEN reaction_smiles IS NULL THEN 'reaction_smiles:source_not_present' END,
      'atom_mapped_reaction_smiles:source_not_present', CASE WHEN reaction_latex IS NULL THEN 'reaction_latex:source_not_present' END,
      'rxn_path:source_not_present,conditions.catalyst:source_not_present,conditions.temperature_c:source_not_present,conditions.time_h:source_not_present,yield_percent:source_not_present')
    END || ',atom_mapped_reaction_smiles:extraction_failed' AS missing
FROM answer_values
""",
)
def _(spark, sf):
    c = R.with_answers(D.answer_candidates(spark, sf), D.model_answers(spark, sf))
    e = R.enrich_record(c)
    p = F.col("payload")
    return e.select(
        "document_id", "candidate_index", p["reaction_text"].alias("reaction_text"), p["reaction_smiles"].alias("reaction_smiles"), p["reaction_latex"].alias("reaction_latex"),
        p["conditions"]["temperature_c"].alias("temperature_c"), p["conditions"]["time_h"].alias("time_h"), p["yield_percent"].alias("yield_percent"),
        F.col("validation.schema_valid").alias("schema_valid"), F.array_join("validation.schema_errors", ";").alias("errors"),
        pairs(F.col("validation.missing")).alias("missing"),
    )


@query(
    "enrich_record",
    """
SELECT document_id, count(*) AS records, sum(yield_percent) AS yields, count(*) FILTER (verdict = 'f') AS failed,
  count(reaction_smiles) AS with_smiles, count(*) FILTER (reaction_smiles IS NOT NULL AND candidate_index % 2 = 1) AS mapped
FROM answer_values GROUP BY document_id
""",
)
def _(spark, sf):
    c = D.answer_candidates(spark, sf).withColumn(
        "mapped", F.when(F.col("candidate_index") % 2 == 1, "[C:1]>>[C:1]")
    )
    e = R.enrich_record(R.with_answers(c, D.model_answers(spark, sf)), "mapped")
    return e.groupBy("document_id").agg(
        F.count(F.lit(1)).alias("records"),
        F.sum("payload.yield_percent").alias("yields"),
        F.count("validation.status").alias("failed"),
        F.count("payload.reaction_smiles").alias("with_smiles"),
        F.count("payload.atom_mapped_reaction_smiles").alias("mapped"),
    )


# first and second answers as written: good, bad, or no JSON
view(
    "answer_kinds",
    """
SELECT cast(conv_id AS varchar) AS document_id, cast(turn AS bigint) AS candidate_index, 1 AS attempt, conv_id, turn,
  CASE (conv_id + turn) % 6 WHEN 0 THEN 'none' WHEN 1 THEN 'good' WHEN 4 THEN 'good' ELSE 'bad' END AS kind
FROM conversations WHERE (conv_id + turn) % 6 < 5
UNION ALL
SELECT cast(conv_id AS varchar), cast(turn AS bigint), 2, conv_id, turn, CASE (conv_id + turn) % 6 WHEN 2 THEN 'good' ELSE 'bad' END
FROM conversations WHERE ((conv_id + turn) % 6 = 3 OR ((conv_id + turn) % 6 = 2 AND conv_id % 2 = 0))
""",
)


@query(
    "loose_json",
    """
SELECT document_id, candidate_index, attempt, kind <> 'none' AS found, CASE kind WHEN 'good' THEN cast(conv_id % 100 AS double) END AS yield_percent,
  CASE kind WHEN 'good' THEN 'null' WHEN 'bad' THEN 'Pd' END AS catalyst FROM answer_kinds
""",
)
def _(spark, sf):
    a = D.model_answers(spark, sf).withColumn("v", X.loose_json(F.col("answer_text")))
    return a.select(
        "document_id", "candidate_index", "attempt", F.col("v").isNotNull().alias("found"),
        F.try_variant_get("v", "$.yield_percent", "double").alias("yield_percent"),
        F.try_variant_get("v", "$.conditions.catalyst", "string").alias("catalyst"),
    )


@query(
    "schema_validate",
    f"""
SELECT document_id, candidate_index, attempt, kind = 'good' AS valid, CASE kind WHEN 'bad' THEN {UNFIT} WHEN 'none' THEN '$ expected "object", got undefined' ELSE '' END AS errors,
  CASE kind WHEN 'good' THEN 'reaction_latex:source_not_present,rxn_path:source_not_present,conditions.catalyst:source_not_present'
    WHEN 'bad' THEN 'reaction_smiles:source_not_present,atom_mapped_reaction_smiles:source_not_present,reaction_latex:source_not_present,rxn_path:source_not_present,conditions.time_h:source_not_present'
    ELSE '' END AS missing FROM answer_kinds
""",
)
def _(spark, sf):
    a = D.model_answers(spark, sf).withColumn("c", S.validate(R.DEFAULT_SCHEMA, X.loose_json(F.col("answer_text"))))
    return a.select("document_id", "candidate_index", "attempt", (F.size("c.errors") == 0).alias("valid"), F.array_join("c.errors", ";").alias("errors"), pairs(F.col("c.missing")).alias("missing"))


@query(
    "schema_projection",
    """
SELECT document_id, candidate_index, attempt, CASE kind WHEN 'good' THEN 'A -> B ' || conv_id END AS reaction_text,
  CASE kind WHEN 'good' THEN CASE WHEN conv_id % 3 = 0 THEN 'CC' ELSE 'CC>>C' || turn END END AS reaction_smiles,
  CASE kind WHEN 'bad' THEN 'Pd' END AS catalyst, CASE kind WHEN 'good' THEN 80.0::double END AS temperature_c, CASE kind WHEN 'good' THEN cast(conv_id % 100 AS double) END AS yield_percent
FROM answer_kinds
""",
)
def _(spark, sf):
    a = D.model_answers(spark, sf).withColumn("p", S.project(R.DEFAULT_SCHEMA, X.loose_json(F.col("answer_text"))))
    return a.select(
        "document_id", "candidate_index", "attempt", "p.reaction_text", "p.reaction_smiles", "p.conditions.catalyst", "p.conditions.temperature_c", "p.yield_percent"
    )


EXAMPLE = {"a": "", "n": 1, "tags": [""], "flag": True, "o": {"x": 1.5, "mass": None}}


@query(
    "schema_from_example",
    """
SELECT event_id, event_type AS a, CASE WHEN event_id % 4 = 0 THEN NULL ELSE cast(json_extract_string(props, '$.k') AS double) END AS n, event_id % 3 = 0 AS flag, value AS x,
  concat_ws(';', CASE WHEN event_id % 4 = 0 THEN 'n expected ["integer","null"], got "many"' END, 'tags[2] expected ["string","null"], got 3') AS errors,
  'tags[1]:source_not_present,o.mass:source_not_present' AS missing, 3 AS n_tags
FROM events
""",
)
def _(spark, sf):
    e = D.table(spark, sf, "events").selectExpr(
        "event_id",
        "concat('{\"a\":\"', event_type, '\",\"n\":\"', case when event_id % 4 = 0 then 'many' else get_json_object(props, '$.k') end,"
        " '\",\"tags\":[\"', event_type, '\",null,3],\"flag\":', event_id % 3 = 0, ',\"z\":1,\"o\":{\"x\":', value, ',\"mass\":\"\"}}') as j",
    )
    c = e.withColumn("c", S.validate(S.schema_from_example(EXAMPLE), F.try_parse_json("j")))
    return c.select(
        "event_id", "c.value.a", "c.value.n", "c.value.flag", "c.value.o.x", F.array_join("c.errors", ";").alias("errors"),
        pairs(F.col("c.missing")).alias("missing"), F.size("c.value.tags").alias("n_tags"),
    )


# ---- rules and identity ---------------------------------------------------------------
view(
    "reaction_rules",
    """
SELECT *, CASE WHEN contains(mapped, '>>') AND regexp_matches(mapped, ':[0-9]+') THEN mapped END AS good_mapped,
  CASE WHEN o_orderkey % 3 < 2 THEN yield_percent END AS good_yield FROM reactions
""",
)


@query(
    "evidence_rules",
    """
SELECT id, good_mapped AS mapped, good_yield AS yield_percent, concat_ws(',', CASE WHEN good_mapped IS NULL THEN 'atom_mapped_reaction_smiles:extraction_failed' END,
  CASE WHEN good_yield IS NULL THEN 'yield_percent:source_not_present' END) AS missing FROM reaction_rules
""",
)
def _(spark, sf):
    r = R.evidence_rules(D.reactions(spark, sf))
    return r.select(
        "id", F.col("payload.atom_mapped_reaction_smiles").alias("mapped"), "payload.yield_percent", pairs(F.col("rule_missing")).alias("missing")
    )


@query(
    "missing_union",
    """
SELECT id, concat_ws(',', CASE WHEN listed_yield THEN 'yield_percent:not_reported' END, CASE WHEN good_mapped IS NULL THEN 'atom_mapped_reaction_smiles:extraction_failed' END,
  CASE WHEN good_yield IS NULL AND NOT listed_yield THEN 'yield_percent:source_not_present' END) AS missing FROM reaction_rules
""",
)
def _(spark, sf):
    return R.apply_rules(D.reactions(spark, sf)).select("id", pairs(F.col("validation.missing")).alias("missing"))


@query(
    "duplicate_check",
    """
WITH s AS (SELECT DISTINCT document_id, coalesce(reaction_smiles, '#') AS a, reaction_text, page_no + CASE WHEN o_orderkey % 2 = 0 THEN 0 ELSE 50 END AS page_no, coalesce(yield_percent, -1) AS y FROM reactions)
SELECT id FROM reactions r WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.document_id = r.document_id AND s.a = coalesce(r.reaction_smiles, '#')
  AND s.reaction_text = r.reaction_text AND s.page_no = r.page_no AND s.y = coalesce(r.yield_percent, -1))
""",
)
def _(spark, sf):
    r = D.reactions(spark, sf)
    # The whole table is stored, odd records on other pages.
    page = F.expr("provenance.page_no + case when cast(substr(id, 2) as bigint) % 2 = 0 then 0 else 50 end")
    return R.duplicate_check(r, r.withColumn("provenance", F.col("provenance").withField("page_no", page))).select("id")


@query(
    "dedupe_first",
    """
SELECT id, concat('x', o_orderkey // 500) AS document_id FROM (SELECT *, row_number() OVER (PARTITION BY o_orderkey // 500, reaction_smiles, reaction_text, page_no, floor(yield_percent / 10) ORDER BY o_orderkey) AS rn FROM reactions) WHERE rn = 1
""",
)
def _(spark, sf):
    r = D.reactions(spark, sf).withColumn("k", F.expr("cast(substr(id, 2) as bigint)"))
    r = r.withColumn("document_id", F.expr("concat('x', k div 500)"))
    r = r.withColumn("payload", F.col("payload").withField("yield_percent", F.floor(F.col("payload.yield_percent") / 10).cast("double")))
    return R.dedupe_first(R.with_fingerprint(r), ["k"]).select("id", "document_id")


@query(
    "distinct_reactions",
    "SELECT document_id, count(*) AS distinct_reactions FROM (SELECT DISTINCT document_id, coalesce(reaction_smiles, reaction_text), page_no, yield_percent, entry_label FROM reactions) GROUP BY 1",
)
def _(spark, sf):
    return R.distinct_reactions(D.reactions(spark, sf))


@query(
    "run_summary",
    """
SELECT 'run' || d.document_id AS run_id, d.document_id, coalesce(r.n, 0) AS distinct_reactions, coalesce(t.n, 0) AS table_count, coalesce(c.n, 0) AS candidate_count
FROM (SELECT DISTINCT document_id FROM entry_blocks) d
LEFT JOIN (SELECT g, count(*) AS n FROM (SELECT DISTINCT concat('o', o_orderkey // 40) AS g, coalesce(reaction_smiles, reaction_text), page_no, yield_percent, entry_label FROM reactions) GROUP BY 1) r ON r.g = d.document_id
LEFT JOIN (SELECT concat('o', c_custkey // 2) AS g, count(*) AS n FROM table_records GROUP BY 1) t ON t.g = d.document_id
LEFT JOIN (SELECT document_id, count(*) AS n FROM candidates GROUP BY 1) c ON c.document_id = d.document_id
""",
)
def _(spark, sf):
    blocks = D.entry_blocks(spark, sf)
    runs = blocks.select("document_id").distinct().selectExpr("concat('run', document_id) as run_id", "document_id")
    key = "cast(substr(id, 2) as bigint)"
    reactions = D.reactions(spark, sf).withColumn("document_id", F.expr(f"concat('o', {key} div 40)"))
    tables = D.table_records(spark, sf).withColumn("document_id", F.expr(f"concat('o', {key} div 2)"))
    found = K.candidate_rows(K.candidate_pages(blocks))
    return R.run_summary(runs, reactions, tables, found).select("run_id", "document_id", "distinct_reactions", "table_count", "candidate_count")


@query(
    "batch_progress",
    """
SELECT concat('job', user_id) AS job_id, count(*) AS total, count(*) FILTER (event_type <> 'error') AS done, count(*) FILTER (event_type = 'error') AS remaining,
  count(*) FILTER (event_type <> 'error') / count(*)::double AS progress FROM events GROUP BY user_id
""",
)
def _(spark, sf):
    e = D.table(spark, sf, "events").selectExpr("concat('job', user_id) as job_id", "event_type <> 'error' as done")
    return R.batch_progress(e)


@query(
    "reaction_participants",
    """
WITH s AS (SELECT id, string_split(reaction_smiles, '>>') AS h FROM reactions WHERE contains(reaction_smiles, '>>')),
p AS (SELECT id, string_split(string_split(h[1], '>')[1], '.') AS a, CASE WHEN contains(h[1], '>') THEN string_split(substr(h[1], instr(h[1], '>') + 1), '.') ELSE [] END AS b, string_split(h[2], '.') AS c FROM s)
SELECT id, 'reactant' AS role, cast(generate_subscripts(a, 1) - 1 AS integer) AS position, unnest(a) AS smiles FROM p
UNION ALL SELECT id, 'agent', cast(generate_subscripts(b, 1) - 1 AS integer), unnest(b) FROM p
UNION ALL SELECT id, 'product', cast(generate_subscripts(c, 1) - 1 AS integer), unnest(c) FROM p
""",
)
def _(spark, sf):
    r = D.reactions(spark, sf).select("id", F.col("payload.reaction_smiles").alias("smiles"))
    return R.reaction_participants(r)


@query(
    "reaction_syntax_errors",
    """
SELECT id, CASE WHEN reaction_smiles IS NULL THEN 'empty_reaction_smiles' WHEN NOT contains(reaction_smiles, '>>') THEN 'reaction_smiles_must_use_reactants_>>_products' END AS error FROM reactions
""",
)
def _(spark, sf):
    return D.reactions(spark, sf).select("id", X.reaction_syntax_error(F.col("payload.reaction_smiles")).alias("error"))
