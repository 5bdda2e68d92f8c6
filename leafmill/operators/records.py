"""Candidates and answers to validated, evidence-checked, distinct records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.functions import example_schema as S
from leafmill.functions import text as X
from leafmill.functions.ordering import filter_here, first_per_key, settled
from leafmill.schemas import CONDITIONS, MISSING, REACTION_PAYLOAD

DEFAULT_SCHEMA = S.schema_from_example(S.DEFAULT_REACTION_EXAMPLE)


def missing_entry(field: str, reason: str | Column) -> Column:
    why = F.lit(reason) if isinstance(reason, str) else reason
    return F.array(F.struct(F.lit(field).alias("field"), why.alias("missing_reason")))


def no_missing() -> Column:
    return F.array().cast(MISSING)


def source_facts(df: DataFrame) -> DataFrame:
    """Adds what a source text tells by itself: whole_text, known_smiles, known_latex."""
    src = F.col("source_text")
    lines = F.array_remove(F.split(src, "\n"), "")
    latex = F.contains(src, F.lit("$$")) | F.contains(src, F.lit("\\mathrm{"))
    # Plain substring tests skip the patterns where they cannot match; what matched is compared as a column, not matched again.
    found = {
        "whole_text": F.array_join(lines, " "),
        "known_smiles": F.when(F.contains(src, F.lit(">>")), F.regexp_extract(src, X.SMILES_TOKEN, 1)),
        "known_latex": F.when(latex, F.regexp_extract(src, X.LATEX_SPAN, 0)),
    }
    return settled(df, found).withColumns({c: X.truthy(F.col(c)) for c in found})


def known_fields(df: DataFrame) -> DataFrame:
    """Adds what each candidate itself tells: known_text, known_smiles, known_latex.

    Flat columns, so each pattern runs once per candidate however often its
    result is used; once per page where the page's facts are there already. The entry
    sentence comes before the source's lines, joined by spaces.
    """
    if "known_text" in df.columns:
        return df
    d = df if "whole_text" in df.columns else source_facts(df)
    sentence = F.format_string(X.ENTRY_SENTENCE, F.col("entry_label"), F.col("page_no"))
    return d.withColumn("known_text", F.when(F.col("entry_label") != "", sentence).otherwise(F.col("whole_text"))).drop("whole_text")


KNOWN = ["known_text", "known_smiles", "known_latex"]


def apply_known_fields(payload: Column | None) -> Column:
    """Payload completed from the known fields; no payload means the null skeleton.

    The entry's yield overrides; page conditions, text, SMILES and LaTeX only fill
    gaps.
    """

    def own(f: str) -> Column:
        return F.lit(None).cast("string") if payload is None else payload[f]

    def gap(f: str, known: str) -> Column:
        return F.col(known) if payload is None else F.coalesce(X.truthy(own(f)), F.col(known), own(f))

    inherited = F.col("inherited_conditions")
    if payload is None:
        conditions = F.struct(*[inherited[k].alias(k) for k in CONDITIONS.fieldNames()])
        share = F.col("yield_percent")
    else:
        given = payload["conditions"]
        filled = F.struct(*[F.coalesce(given[k], inherited[k]).alias(k) for k in CONDITIONS.fieldNames()])
        conditions = F.when(given.isNotNull(), filled)
        share = F.coalesce(F.col("yield_percent"), payload["yield_percent"])
    return F.struct(
        gap("reaction_text", "known_text").alias("reaction_text"),
        gap("reaction_smiles", "known_smiles").alias("reaction_smiles"),
        own("atom_mapped_reaction_smiles").alias("atom_mapped_reaction_smiles"),
        gap("reaction_latex", "known_latex").alias("reaction_latex"),
        own("rxn_path").alias("rxn_path"),
        conditions.alias("conditions"),
        share.alias("yield_percent"),
    )


def with_answers(candidates: DataFrame, answers: DataFrame) -> DataFrame:
    """Candidates with the JSON found in their first and second (repair) answer.

    One answer row per (document_id, candidate_index, attempt); the pair is put
    side by side by a partial aggregation before the join.
    """
    pair = answers.groupBy("document_id", "candidate_index").agg(
        F.max(F.when(F.col("attempt") == 1, F.col("answer_text"))).alias("_a1"),
        F.max(F.when(F.col("attempt") == 2, F.col("answer_text"))).alias("_a2"),
    )
    return (
        candidates.join(pair, ["document_id", "candidate_index"], "left")
        .withColumns({"answer": X.loose_json(F.col("_a1")), "repair": X.loose_json(F.col("_a2"))})
        .drop("_a1", "_a2")
    )


def _choose_value(d: DataFrame) -> DataFrame:
    """_value, _valid, _errors and _missing from answer, repair and known fields."""
    schema = DEFAULT_SCHEMA
    fallback = apply_known_fields(None)
    no_errors = F.array().cast("array<string>")
    if "answer" not in d.columns:
        return d.withColumns(
            {"_value": fallback, "_valid": F.lit(True), "_errors": no_errors, "_missing": S.missing_of(schema, fallback)}
        )

    def present(c: str) -> Column:
        # A JSON null answer is as good as none.
        return F.when(~F.is_variant_null(c), F.col(c))

    # One check expression serves both answers.
    checks = F.transform(
        F.array(present("answer"), present("repair")), lambda v: F.when(v.isNotNull(), S.validate(schema, v))
    )
    d = d.withColumn("_c", checks).withColumns({"_c1": F.get("_c", F.lit(0)), "_c2": F.get("_c", F.lit(1))}).drop("_c")
    ok1 = F.size("_c1.errors") == 0
    use2 = F.col("_c1").isNotNull() & F.col("_c2").isNotNull() & ~ok1
    d = d.withColumn(
        "_pick",
        F.when(F.coalesce(ok1, F.lit(False)), 1)
        .when(use2 & (F.size("_c2.errors") == 0), 2)
        .when(use2, 3)
        .otherwise(0),
    )
    pick = F.col("_pick")
    return d.withColumns(
        {
            "_value": F.when(pick == 1, F.col("_c1.value")).when(pick == 2, F.col("_c2.value")).otherwise(fallback),
            "_valid": pick != 3,
            "_errors": F.when(pick == 3, F.col("_c2.errors")).otherwise(no_errors),
            "_missing": F.when(pick == 1, F.col("_c1.missing"))
            .when(pick >= 2, F.col("_c2.missing"))
            .otherwise(S.missing_of(schema, fallback)),
        }
    ).drop("_c1", "_c2", "_pick", "answer", "repair")


def enrich_record(df: DataFrame, mapped_smiles: str | None = None) -> DataFrame:
    """Adds payload and validation to candidates, with answers or without.

    First answer if it fits the schema, else the repair if that fits, else the
    known-field fallback. A missing answer counts as the fallback, which fits; a
    repair that is present but does not fit leaves the record validation_failed
    with the repair's errors. A mapped SMILES comes from the named input column
    only, never from an answer.
    """
    d = _choose_value(known_fields(df))
    completed = F.col("_value") if "answer" not in df.columns else apply_known_fields(F.col("_value"))
    d = d.withColumn("payload", completed).drop("_value")
    d = d.withColumn("_smiles", X.truthy(F.col("payload.reaction_smiles")))
    d = d.withColumn("_good", F.coalesce(X.is_reaction(F.col("_smiles")), F.lit(False)))
    bad = F.col("_smiles").isNotNull() & ~F.col("_good")
    none = F.lit(None).cast("string")
    mapped = F.when(F.col("_good"), F.col(mapped_smiles)) if mapped_smiles else none
    p = F.col("payload")
    payload = F.struct(
        p["reaction_text"].alias("reaction_text"),
        F.when(~bad, p["reaction_smiles"]).alias("reaction_smiles"),
        mapped.alias("atom_mapped_reaction_smiles"),
        p["reaction_latex"].alias("reaction_latex"),
        F.when(~F.col("_good"), p["rxn_path"]).alias("rxn_path"),
        p["conditions"].alias("conditions"),
        p["yield_percent"].alias("yield_percent"),
    )
    failed_smiles = missing_entry("reaction_smiles", "extraction_failed")
    failed_mapping = missing_entry("atom_mapped_reaction_smiles", "extraction_failed")
    validation = F.struct(
        F.col("_valid").alias("schema_valid"),
        F.col("_errors").alias("schema_errors"),
        F.concat(
            F.col("_missing"),
            F.when(bad, failed_smiles).otherwise(no_missing()),
            F.when(mapped.isNull(), failed_mapping).otherwise(no_missing()),
        ).alias("missing"),
        F.when(~F.col("_valid"), "validation_failed").alias("status"),
    )
    return d.withColumns({"validation": validation, "payload": payload}).drop(
        "_smiles", "_good", "_valid", "_errors", "_missing", *KNOWN
    )


def reaction_provenance(mapper: str | None = None, version: str | None = None) -> Column:
    """Evidence of a candidate; candidate columns are in scope, among them the mapper's name and version if named."""

    def told(c: str | None) -> Column:
        return F.col(c) if c else F.lit(None).cast("string")

    return F.struct(
        "page_no",
        "bbox",
        "source_type",
        "source_text",
        F.col("image_path").alias("source_image_path"),
        "entry_label",
        "block_ids",
        told(mapper).alias("atom_mapper"),
        told(version).alias("atom_mapper_version"),
    )


def keep_reaction(df: DataFrame) -> DataFrame:
    """Records with a checkable conversion; payload and candidate columns in scope."""

    def text(c: str) -> Column:
        return F.coalesce(F.col(c), F.lit(""))

    keep = (
        F.contains(text("payload.reaction_smiles"), F.lit(">>"))
        | text("payload.reaction_latex").rlike(X.LATEX_ARROW)
        | F.coalesce(F.col("source_type") == "scheme_entry", F.lit(False))
        | (text("entry_label") != "")
        | text("payload.reaction_text").rlike(X.CONVERSION_TEXT)
    )
    return filter_here(df, keep)


def evidence_rules(df: DataFrame, yield_text: str | None = None) -> DataFrame:
    """Payload after the business rules, and what they add as ``rule_missing``.

    A mapped SMILES must hold >> and a mapped atom. A yield must be written as
    ``N%`` in the source text. ``yield_text`` names a column with the yield as
    given, when that may not be a number. Rows with ``percents`` bring the numbers that
    their source mentions, or ``seen`` for a yield known from there, in place of the text.
    """
    mapped = F.col("payload.atom_mapped_reaction_smiles")
    share = F.col("payload.yield_percent")
    given = X.truthy(F.col(yield_text)) if yield_text else share.cast("string")
    d = df.withColumns(
        {
            "_mapped_ok": F.coalesce(F.contains(mapped, F.lit(">>")) & mapped.rlike(X.MAPPED_ATOM), F.lit(False)),
            "_number": X.to_number(F.col(yield_text)) if yield_text else share,
            "_given": given.isNotNull(),
        }
    )
    # Flat columns, so the source text is searched once, or not at all where the page was.
    if "percents" in df.columns:
        d = d.withColumn("_seen", F.coalesce("seen", X.among_percents(F.col("percents"), F.col("_number")))).drop("seen", "percents")
    else:
        d = d.withColumn("_seen", X.mentions_percent(F.col("provenance.source_text"), F.col("_number")))
    changed = {
        "atom_mapped_reaction_smiles": F.when(F.col("_mapped_ok"), mapped),
        "yield_percent": F.when(F.col("_seen"), F.col("_number")),
    }
    payload = F.struct(*[changed.get(f, F.col(f"payload.{f}")).alias(f) for f in REACTION_PAYLOAD.fieldNames()])
    unread = F.col("_given") & F.col("_number").isNull()
    missing = F.concat(
        F.when(F.col("_mapped_ok"), no_missing()).otherwise(missing_entry("atom_mapped_reaction_smiles", "extraction_failed")),
        F.when(unread, missing_entry("yield_percent", "extraction_failed"))
        .when(F.col("_seen"), no_missing())
        .otherwise(missing_entry("yield_percent", "source_not_present")),
    )
    return d.withColumns({"payload": payload, "rule_missing": missing}).drop("_mapped_ok", "_number", "_given", "_seen")


def missing_union(existing: Column, added: Column) -> Column:
    """Existing entries first; an added entry only for a field not listed yet."""
    listed = existing["field"]
    return F.concat(existing, F.filter(added, lambda e: ~F.array_contains(listed, e["field"])))


def apply_rules(df: DataFrame) -> DataFrame:
    """Save-time rules on payload, provenance and validation columns."""
    existing = F.coalesce("validation.missing", no_missing())
    whole = missing_union(existing, F.col("rule_missing"))
    return (
        evidence_rules(df)
        .withColumn("validation", F.col("validation").withField("missing", whole))
        .drop("rule_missing")
    )


def fingerprint(payload: Column, page_no: Column) -> Column:
    """Null-safe identity of a record inside its document: each part length-prefixed."""
    parts = [payload["reaction_smiles"], payload["reaction_text"], page_no.cast("string"), payload["yield_percent"].cast("string")]
    return F.sha1(F.concat(*[F.coalesce(F.concat(F.length(p).cast("string"), F.lit(":"), p), F.lit("-")) for p in parts]))


# The page is part of the identity, so naming it beside the fingerprint lets work
# already partitioned by (document, page) stay where it is.
IDENTITY = ["document_id", "page_no", "fingerprint"]
# Of a payload the identity reads these.
IDENTITY_FIELDS = ["reaction_smiles", "reaction_text", "yield_percent"]


def with_fingerprint(df: DataFrame) -> DataFrame:
    if "page_no" not in df.columns:
        # Null and 0 still differ in the fingerprint.
        df = df.withColumn("page_no", F.coalesce("provenance.page_no", F.lit(0)))
    return df.withColumn("fingerprint", fingerprint(F.col("payload"), F.col("page_no")))


def duplicate_check(new: DataFrame, stored: DataFrame) -> DataFrame:
    """New records whose identity is not stored for the document yet.

    The stored side is one row per identity, so a hot document spreads out.
    """
    seen = with_fingerprint(stored).select(*IDENTITY).distinct()
    return with_fingerprint(new).join(seen, IDENTITY, "left_anti")


def dedupe_first(df: DataFrame, order: list[str]) -> DataFrame:
    """First record per identity."""
    return first_per_key(df, IDENTITY, order)


def append_reactions(new: DataFrame, stored: DataFrame | None, order: list[str], parts: int | None = None) -> DataFrame:
    """Rows to append: rules applied, then only identities not seen before.

    Both sides are compared after the rules, so a rerun appends nothing. ``new``
    has page_no equal to its provenance page. A page's stored identities meet its new
    rows as one list, so rows laid out by page are not moved by their whole identity;
    ``parts`` is the number of parts in which they are.
    """
    fresh = with_fingerprint(apply_rules(new))
    if stored is not None:
        fresh = not_stored(fresh, with_fingerprint(stored), parts)
    return dedupe_first(fresh, order)


def not_stored(fresh: DataFrame, stored: DataFrame, parts: int | None = None) -> DataFrame:
    """Rows whose identity is not among their page's stored ones; both sides with their identity."""
    page = ["document_id", "page_no"]
    seen = stored.select(*IDENTITY)
    # Laid out as the rows are, or the rows would be dealt again to meet it.
    seen = seen if parts is None else seen.repartition(parts, *page)
    seen = seen.groupBy(*page).agg(F.collect_set("fingerprint").alias("_seen"))
    known = F.coalesce(F.array_contains("_seen", F.col("fingerprint")), F.lit(False))
    return fresh.join(seen, page, "left").filter(~known).drop("_seen")


def distinct_reactions(reactions: DataFrame) -> DataFrame:
    """Distinct (SMILES else text, page, yield, label) per document; deletes nothing."""
    key = F.struct(
        F.coalesce("payload.reaction_smiles", "payload.reaction_text").alias("a"),
        F.col("provenance.page_no").alias("b"),
        F.col("payload.yield_percent").alias("c"),
        F.col("provenance.entry_label").alias("d"),
    )
    return (
        reactions.select("document_id", key.alias("k"))
        .distinct()
        .groupBy("document_id")
        .agg(F.count(F.lit(1)).alias("distinct_reactions"))
    )


def run_summary(runs: DataFrame, reactions: DataFrame, tables: DataFrame, candidates: DataFrame) -> DataFrame:
    """Distinct reactions, tables and candidates of each run's document."""

    def count(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("document_id").agg(F.count(F.lit(1)).alias(name))

    names = ["distinct_reactions", "table_count", "candidate_count"]
    return (
        runs.select("run_id", "document_id")
        .join(distinct_reactions(reactions), "document_id", "left")
        .join(count(tables, "table_count"), "document_id", "left")
        .join(count(candidates, "candidate_count"), "document_id", "left")
        .na.fill(0, names)
    )


def batch_progress(outcomes: DataFrame) -> DataFrame:
    """done / max(total, 1) and remaining per job; 1 when every file is done."""
    done = F.count_if("done")
    total = F.count(F.lit(1))
    return outcomes.groupBy("job_id").agg(
        total.alias("total"),
        done.alias("done"),
        (total - done).alias("remaining"),
        (done / F.greatest(total, F.lit(1))).alias("progress"),
    )


def reaction_participants(records: DataFrame, smiles: str = "smiles", keys: list[str] | None = None) -> DataFrame:
    """One row per participant: keys, role, position, smiles."""
    keys = keys or ["id"]
    text = records.filter(X.is_reaction(F.col(smiles))).select(*keys, X.strip(F.col(smiles)).alias("_t"))
    sides = X.reaction_sides(F.col("_t")).items()

    def role(name: str, pattern: str) -> Column:
        return F.transform(
            X.reaction_side(pattern),
            lambda x, i: F.struct(F.lit(name).alias("role"), i.alias("position"), x.alias("smiles")),
        )

    rows = F.concat(*[role(n, p) for n, p in sides])
    return text.select(*keys, F.explode(rows).alias("_r")).select(*keys, "_r.role", "_r.position", "_r.smiles")
