"""Records of any example: payloads by the schema that a user's example implies.

The expressions are generated from the schema, one per leaf, so an extraction stays one
projection whatever the example holds. A payload is carried as one variant per top-level
key while the rules run, and stored as a single variant; the fixed fields that identity
and rules read are taken out beside it, so both work as for the default example. Known
fields that the example lacks are added as keys; unknown ones are null.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafmill.functions import example_schema as S
from leafmill.functions import text as X
from leafmill.functions import variants as V
from leafmill.functions.ordering import settled
from leafmill.functions.variants import plain_number
from leafmill.operators import records as R
from leafmill.schemas import CONDITIONS, REACTION_PAYLOAD
from leafmill.session import materialize

TEXTS = {"reaction_text": "known_text", "reaction_smiles": "known_smiles", "reaction_latex": "known_latex"}
ADDED = ["reaction_text", "yield_percent", "reaction_smiles", "reaction_latex", "atom_mapped_reaction_smiles", "rxn_path"]
# Optional columns of a candidate that a mapping service filled.
MAPPING = {"mapped_smiles": "string", "mapper": "string", "mapper_version": "string", "mapping_reason": "string", "made_rxn_path": "string"}


def user_schema(example: dict[str, Any]) -> S.Node:
    if not isinstance(example, dict):
        raise ValueError("an example is a JSON object")
    return S.schema_from_example(example)


def as_variant(node: S.Node, value: Column) -> Column:
    """A typed value as a variant; SQL null stays null."""
    if "object" in node.types:
        return F.when(value.isNotNull(), F.to_variant_object(plain(node, value)))
    if "array" in node.types:
        return F.when(value.isNotNull(), F.to_variant_object(plain(node, value)))
    return plain_number(value) if isinstance(node.spark_type(), T.DoubleType) else value.cast("variant")


def plain(node: S.Node, value: Column) -> Column:
    """A typed value whose numbers print plainly; keys keep the example's order."""
    if "object" in node.types:
        return F.when(value.isNotNull(), F.struct(*[plain(c, value[k]).alias(k) for k, c in node.children.items()]))
    if "array" in node.types:
        return F.transform(value, lambda x: plain(node.items, x))
    return plain_number(value) if isinstance(node.spark_type(), T.DoubleType) else value


def _is_object(node: S.Node | None) -> bool:
    return node is not None and "object" in node.types


def _truthy(node: S.Node, value: Column) -> Column:
    kind = node.spark_type()
    if isinstance(kind, T.StringType):
        return F.coalesce(value != "", F.lit(False))
    if isinstance(kind, T.DoubleType):
        return F.coalesce((value != 0) & ~F.isnan(value), F.lit(False))
    return F.coalesce(value, F.lit(False)) if isinstance(kind, T.BooleanType) else value.isNotNull()


def completed(node: S.Node, value: Column) -> dict[str, Column]:
    """Variants by key: a value of the schema, completed from the known fields.

    The entry's yield overrides; page conditions and texts only fill gaps.
    """
    own = {k: as_variant(c, value[k]) for k, c in node.children.items()}
    null = F.lit(None).cast("variant")
    out = dict(own)
    for key, known in TEXTS.items():
        told = F.col(known).cast("variant")
        child = node.children.get(key)
        out[key] = told if child is None else F.when(_truthy(child, value[key]), own[key]).otherwise(F.coalesce(told, own[key]))
    out["yield_percent"] = F.coalesce(plain_number(F.col("yield_percent")), own.get("yield_percent", null))
    given = node.children.get("conditions")
    if _is_object(given):
        inherited = {k: F.col("inherited_conditions")[k] for k in CONDITIONS.fieldNames()}
        told = {k: plain_number(c) if isinstance(CONDITIONS[k].dataType, T.DoubleType) else c.cast("variant") for k, c in inherited.items()}
        kept = {k: as_variant(c, value["conditions"][k]) for k, c in given.children.items()}
        both = F.struct(*[F.coalesce(*[m[k] for m in (kept, told) if k in m]).alias(k) for k in [*kept, *(k for k in told if k not in kept)]])
        out["conditions"] = F.when(value["conditions"].isNotNull(), F.to_variant_object(both))
    for key in ("atom_mapped_reaction_smiles", "rxn_path"):
        out.setdefault(key, null)
    return {k: out[k] for k in [*node.children, *(k for k in ADDED if k not in node.children)]}


def fallback(node: S.Node) -> Column:
    """The record that a candidate's known fields make alone, as a variant."""
    parts = completed(node, S.null_skeleton(node))
    return F.to_variant_object(F.struct(*[parts[k].alias(k) for k in node.children]))


def _empty(node: S.Node) -> dict[str, Any]:
    """The null skeleton as such a tree: nested objects kept."""
    return {k: _empty(c) if _is_object(c) else None for k, c in node.children.items()}


def told_alone(node: S.Node) -> dict[str, Any] | None:
    """The fallback as a tree for ``S.validate``, of the columns in ``_told``; None where a number would stand for an object."""
    told = F.col("_told")

    def inherited(k: str, child: S.Node) -> Any:
        if _is_object(child):
            return _empty(child)
        if k not in CONDITIONS.fieldNames():
            return None
        number = isinstance(CONDITIONS[k].dataType, T.DoubleType)
        return ("NUMBER" if number else "STRING", told["inherited_conditions"][k])

    tree: dict[str, Any] = {}
    for key, child in node.children.items():
        if key == "conditions" and _is_object(child):
            tree[key] = {k: inherited(k, c) for k, c in child.children.items()}
        elif _is_object(child):
            if key == "yield_percent":
                return None
            tree[key] = _empty(child)
        elif key in TEXTS:
            tree[key] = ("STRING", told[TEXTS[key]])
        else:
            tree[key] = ("NUMBER", told["yield_percent"]) if key == "yield_percent" else None
    return tree


def with_figures(candidates: DataFrame, figures: DataFrame) -> DataFrame:
    """Candidates with the JSON read from their page's figure: (document_id, candidate_index, answer_text).

    Only schemes are read from figures; text that is no JSON counts as no answer.
    """
    one = figures.groupBy("document_id", "candidate_index").agg(F.max("answer_text").alias("_figure"))
    scheme = F.col("source_type") == "reaction_scheme"
    found = candidates.join(one, ["document_id", "candidate_index"], "left")
    return found.withColumn("figure", F.when(scheme, X.loose_json(F.col("_figure")))).drop("_figure")


def _where(valid: Column, node: S.Node, value: Column) -> Column:
    """The value, or the null skeleton: leaf by leaf, so that leaves known to be null stay known."""
    return F.struct(*[(_where(valid, c, value[k]) if _is_object(c) else F.when(valid, value[k])).alias(k) for k, c in node.children.items()])


def _checked(d: DataFrame, node: S.Node) -> DataFrame:
    """_value, _valid, _errors, _missing: the figure's answer, the model's, or the known fields, and one repair."""
    told = fallback(node)

    def present(c: str) -> Column:
        return F.when(~F.is_variant_null(c), F.col(c)) if c in d.columns else F.lit(None).cast("variant")

    figure = F.col("figure") if "figure" in d.columns else F.lit(None).cast("variant")
    if not {"figure", "answer", "repair"} & set(d.columns):
        # Nothing was answered: both tries are the known fields, so one is judged.
        tree = told_alone(node)
        if tree is not None:
            # They are typed, so no variant is made to be looked into; -0.0 counts as 0 there, too.
            share = (F.col("yield_percent") + F.lit(0.0)).alias("yield_percent")
            d = d.withColumn("_told", F.struct(*R.KNOWN, share, "inherited_conditions"))
            judged = S.validate(node, tree)
            d = settled(d, {"_errors": judged["errors"], "_missing": judged["missing"]}).withColumn("_valid", F.size("_errors") == 0)
            return d.withColumn("_value", _where(F.col("_valid"), node, judged["value"])).drop("_told")
        d = settled(d, {"_told": told})
        d = settled(d, {"_c": S.validate(node, F.col("_told"))}).drop("_told")
        ok = F.size("_c.errors") == 0
        judged = {
            "_value": F.when(ok, F.col("_c.value")).otherwise(S.null_skeleton(node)),
            "_valid": ok,
            "_errors": F.col("_c.errors"),
            "_missing": F.col("_c.missing"),
        }
        return settled(d, judged).drop("_c")
    d = settled(d, {"_told": told})
    tries = F.array(F.coalesce(figure, present("answer"), F.col("_told")), F.coalesce(present("repair"), F.col("_told")))
    # One check expression serves both.
    d = settled(d, {"_c": F.transform(tries, lambda v: S.validate(node, v))}).drop("_told")
    d = d.withColumns({"_c1": F.get("_c", F.lit(0)), "_c2": F.get("_c", F.lit(1))}).drop("_c")
    ok1, ok2 = F.size("_c1.errors") == 0, F.size("_c2.errors") == 0
    return settled(
        d,
        {
            "_value": F.when(ok1, F.col("_c1.value")).when(ok2, F.col("_c2.value")).otherwise(S.null_skeleton(node)),
            "_valid": ok1 | ok2,
            "_errors": F.when(ok1, F.col("_c1.errors")).otherwise(F.col("_c2.errors")),
            "_missing": F.when(ok1, F.col("_c1.missing")).otherwise(F.col("_c2.missing")),
        },
    ).drop("_c1", "_c2")


def _string(v: Column) -> Column:
    return F.when(V.kind(v) == "STRING", V.text_of(v))


def core_of(part, wanted: list[str] | None = None) -> Column:
    """The fixed fields of a payload, or those wanted; ``part`` gives the variant under a key."""
    fields = {
        "reaction_text": V.text_of(part("reaction_text")),
        "reaction_smiles": _string(part("reaction_smiles")),
        "atom_mapped_reaction_smiles": _string(part("atom_mapped_reaction_smiles")),
        "reaction_latex": _string(part("reaction_latex")),
        "rxn_path": _string(part("rxn_path")),
        "conditions": F.lit(None).cast(CONDITIONS),
        "yield_percent": F.coalesce(F.try_variant_get(part("yield_percent"), "$", "double"), X.to_number(_string(part("yield_percent")))),
    }
    return F.struct(*[fields[k].alias(k) for k in wanted or REACTION_PAYLOAD.fieldNames()])


def enrich_user_record(df: DataFrame, example: dict[str, Any]) -> DataFrame:
    """Adds parts (variants by key), payload (the fixed fields) and validation to candidates.

    ``answer``, ``repair`` and ``figure`` may be there as variants, and the columns of
    ``MAPPING`` with a mapping service's results. A mapped SMILES comes from there only.
    """
    node = user_schema(example)
    d = df.withColumns({c: F.lit(None).cast(t) for c, t in MAPPING.items() if c not in df.columns})
    d = _checked(R.known_fields(d), node)
    parts = completed(node, F.col("_value"))
    d = settled(d, {"parts": F.struct(*[c.alias(k) for k, c in parts.items()])}).drop("_value")
    d = settled(d, {"payload": core_of(lambda k: F.col("parts")[k])})
    d = d.withColumn("_smiles", X.truthy(F.col("payload.reaction_smiles")))
    d = settled(d, {"_good": F.coalesce(X.is_reaction(F.col("_smiles")), F.lit(False)), "_bad": F.col("_smiles").isNotNull()})
    good, bad = F.col("_good"), F.col("_bad") & ~F.col("_good")
    mapped = F.when(good, F.col("mapped_smiles"))
    why = F.when(good, F.coalesce("mapping_reason", F.lit("extraction_failed"))).otherwise("extraction_failed")
    p = F.col("payload")
    # A SMILES that does not read as a reaction goes.
    changed = {
        "reaction_smiles": F.when(~bad, p["reaction_smiles"]),
        "atom_mapped_reaction_smiles": mapped,
        "rxn_path": F.when(good, F.col("made_rxn_path")).otherwise(p["rxn_path"]),
    }
    validation = F.struct(
        F.col("_valid").alias("schema_valid"),
        F.col("_errors").alias("schema_errors"),
        F.concat(
            F.col("_missing"),
            F.when(bad, R.missing_entry("reaction_smiles", "extraction_failed")).otherwise(R.no_missing()),
            F.when(mapped.isNull(), R.missing_entry("atom_mapped_reaction_smiles", why)).otherwise(R.no_missing()),
        ).alias("missing"),
        F.when(~F.col("_valid"), "validation_failed").alias("status"),
        F.when(good, F.col("mapper")).alias("mapper"),
        F.when(good, F.col("mapper_version")).alias("mapper_version"),
    )
    whole = {
        "validation": validation,
        "payload": F.struct(*[changed.get(f, p[f]).alias(f) for f in REACTION_PAYLOAD.fieldNames()]),
        "parts": F.col("parts").withField("reaction_smiles", F.when(~bad, F.col("parts.reaction_smiles"))),
    }
    return settled(d, whole).drop("_smiles", "_good", "_bad", "_valid", "_errors", "_missing", *MAPPING, *R.KNOWN)


def provenance() -> Column:
    """Evidence of an enriched candidate; a mapper counts where it was asked."""
    return R.reaction_provenance("validation.mapper", "validation.mapper_version")


def final_payload(df: DataFrame) -> DataFrame:
    """One variant in place of parts and fixed fields."""
    keys = df.schema["parts"].dataType.fieldNames()
    changed = {
        "atom_mapped_reaction_smiles": F.col("payload.atom_mapped_reaction_smiles").cast("variant"),
        "rxn_path": F.col("payload.rxn_path").cast("variant"),
    }
    whole = F.to_variant_object(F.struct(*[changed.get(k, F.col("parts")[k]).alias(k) for k in keys]))
    return df.withColumn("payload", whole).drop("parts")


def ruled(df: DataFrame) -> DataFrame:
    """Save-time rules; the yield is judged as it was given."""
    given = settled(df, {"_given": V.text_of(F.col("parts.yield_percent"))})
    existing = F.coalesce("validation.missing", R.no_missing())
    changed = {
        "validation": F.col("validation").withField("missing", R.missing_union(existing, F.col("rule_missing"))),
        "parts": F.col("parts").withField("yield_percent", plain_number(F.col("payload.yield_percent"))),
        "payload": F.col("payload"),
    }
    return settled(R.evidence_rules(given, "_given"), changed).drop("rule_missing", "_given")


def stored_core(stored: DataFrame) -> DataFrame:
    """Stored records with the fixed fields in place of the variant payload."""
    return settled(stored, {"payload": core_of(lambda k: V.field(F.col("payload"), k))})


def stored_identities(stored: DataFrame) -> DataFrame:
    """Identities of stored records; of a payload only the fields that make one up are read."""
    page = F.coalesce("provenance.page_no", F.lit(0)).alias("page_no")
    core = core_of(lambda k: V.field(F.col("payload"), k), R.IDENTITY_FIELDS)
    return R.with_fingerprint(settled(stored.select("document_id", page, "payload"), {"payload": core})).select(*R.IDENTITY)


def append_user_records(new: DataFrame, stored: DataFrame | None, order: list[str], parts: int | None = None) -> DataFrame:
    """Records to append, with variant payloads: rules, then identities not seen before."""
    return final_payload(_unseen(R.with_fingerprint(ruled(new)), stored, order, parts))


def _unseen(fresh: DataFrame, stored: DataFrame | None, order: list[str], parts: int | None) -> DataFrame:
    if stored is not None:
        fresh = R.not_stored(fresh, stored_identities(stored), parts)
    return R.dedupe_first(fresh, order)


def known_identity(example: dict[str, Any]) -> bool:
    """Do the known fields alone make up the identity of an unanswered record? They do where the example has texts for texts."""
    children = user_schema(example).children
    texts = all(k not in children or children[k].types == ("string", "null") for k in TEXTS)
    return texts and not _is_object(children.get("yield_percent"))


def known_payload(candidates: DataFrame) -> DataFrame:
    """Unanswered candidates with the fixed fields of their payload, as ``enrich_user_record`` gives them."""
    d = R.known_fields(candidates)
    smiles = F.when(X.is_reaction(F.col("known_smiles")), F.col("known_smiles"))
    fixed = {
        "reaction_text": F.col("known_text"),
        "reaction_smiles": smiles,
        "reaction_latex": F.col("known_latex"),
        "yield_percent": F.col("yield_percent") + F.lit(0.0),
    }
    return d.withColumn("payload", F.struct(*[fixed.get(f.name, F.lit(None).cast(f.dataType)).alias(f.name) for f in REACTION_PAYLOAD.fields]))


def choose_known(kept: DataFrame, stored: DataFrame | None, order: list[str], parts: int | None = None) -> DataFrame:
    """Candidates to append, by the identity of their known fields after the rules; nothing else of a record is made for it.

    ``seen`` tells from here on whether the source mentions the yield.
    """
    share = F.col("payload.yield_percent")
    seen = F.coalesce("seen", X.among_percents(F.col("percents"), share), F.lit(False))
    judged = kept.withColumn("seen", seen).drop("percents")
    judged = judged.withColumn("payload", F.col("payload").withField("yield_percent", F.when(F.col("seen"), share)))
    return _unseen(R.with_fingerprint(judged).drop("payload"), stored, order, parts)


def records_of_known(chosen: DataFrame, example: dict[str, Any]) -> DataFrame:
    """Chosen candidates, beside their evidence, as records with variant payloads."""
    d = enrich_user_record(chosen.withColumn("percents", F.lit(None).cast("array<string>")), example)
    return final_payload(ruled(d))


def saved(records: DataFrame, run_id: str | None = None, at: Column | None = None, status: str = "pending") -> DataFrame:
    """Appended records as stored rows: id from document and identity, run, status and times.

    A rerun gives the same ids, whatever its time.
    """
    when = F.current_timestamp() if at is None else at
    return records.select(
        F.sha2(F.concat_ws("/", "document_id", "fingerprint"), 256).alias("id"),
        "document_id",
        "payload",
        "provenance",
        "validation",
        F.lit(status).alias("review_status"),
        F.lit(run_id).cast("string").alias("run_id"),
        when.alias("created_at"),
        when.alias("updated_at"),
    )


def save_submitted(submissions: DataFrame, stored: DataFrame, example: dict[str, Any]) -> DataFrame:
    """What becomes of records submitted one by one: (document_id, seq, payload variant, provenance).

    A payload that does not fit the schema is refused with its errors; one whose identity
    is stored, or was submitted earlier, names the record it repeats; others are saved.
    ``stored`` has id, document_id, payload (variant) and provenance.
    """
    node = user_schema(example)
    d = settled(submissions, {"_c": S.validate(node, F.col("payload"))})
    keys = [*node.children, *(k for k in ADDED if k not in node.children)]
    null = F.lit(None).cast("variant")
    parts = F.struct(*[(as_variant(node.children[k], F.col("_c.value")[k]) if k in node.children else null).alias(k) for k in keys])
    validation = F.struct((F.size("_c.errors") == 0).alias("schema_valid"), F.col("_c.errors").alias("schema_errors"), F.col("_c.missing").alias("missing"))
    d = settled(d, {"parts": parts, "validation": validation}).drop("_c")
    d = R.with_fingerprint(ruled(settled(d, {"payload": core_of(lambda k: F.col("parts")[k])})))
    # Judged once, written, and read for identities and for the records.
    d = materialize(d, "submitted")
    identity = R.IDENTITY
    seen = R.with_fingerprint(stored_core(stored)).groupBy(*identity).agg(F.min("id").alias("_stored"))
    valid = F.col("validation.schema_valid")
    first = d.where(valid).groupBy(*identity).agg(F.min("seq").alias("_first"))
    d = d.join(seen, identity, "left").join(first, identity, "left")
    own = F.sha2(F.concat_ws("/", "document_id", "fingerprint"), 256)
    again = F.when(F.col("_stored").isNotNull(), F.col("_stored")).when(F.col("seq") > F.col("_first"), own)
    d = d.withColumns({"duplicate_of": F.when(valid, again), "saved": valid & again.isNull(), "id": F.when(valid & again.isNull(), own)})
    return final_payload(d).select("document_id", "seq", "saved", "id", "duplicate_of", "payload", "provenance", "validation")


def in_scope(blocks: DataFrame, documents: DataFrame) -> DataFrame:
    """Blocks on pages 1 to page_count (at least one) of catalogued documents."""
    pages = documents.select(F.col("id").alias("document_id"), F.greatest("page_count", F.lit(1)).alias("_pages"))
    return blocks.join(pages, "document_id").where(F.col("page_no").between(1, F.col("_pages"))).drop("_pages")


def projected_text(example: dict[str, Any], payload: Column) -> Column:
    """JSON text of a payload in the example's shape and key order, null fields kept."""
    node = user_schema(example)
    return V.bind(S.project(node, payload), lambda v: F.to_json(plain(node, v), {"ignoreNullFields": "false"}))
