"""HTML tables to typed columns.

A table is one value, so headers, cells and column types come from array
expressions on its own row: no shuffle until the long form is regrouped.
"""

from __future__ import annotations

from html.entities import name2codepoint

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.functions import text as X
from leafmill.functions.ordering import dense_position, settled
from leafmill.functions.variants import bind
from leafmill.sources import versioned

# Cell texts read as null.
NULL_CELLS = ["", "na", "n/a", "-", "—", "null"]
# Characters of the named references; a non-breaking space reads as a space.
NAMED = {name: chr(code) for name, code in name2codepoint.items()} | {"apos": "'", "nbsp": " "}
# Tags that open or close parts of a table; comments are gone before.
PART = r"(?is)<(/?)(table|thead|tbody|tfoot|tr|t[dh])(?:[\s/][^>]*)?>"
RUN = 256


def unescaped(c: Column) -> Column:
    """Character references decoded once, by name or number; others stay as written."""
    named = F.create_map(*[F.lit(x) for pair in NAMED.items() for x in pair])

    def piece(p: Column, i: Column) -> Column:
        ref = F.substring_index(p, ";", 1)
        code = F.when(ref.rlike("^#[0-9]{1,7}$"), F.substring(ref, 2, 7).try_cast("int")).when(
            ref.rlike("^#[xX][0-9a-fA-F]{1,6}$"), F.conv(F.substring(ref, 3, 6), 16, 10).try_cast("int")
        )
        valid = (code > 0) & (code < 0x110000) & ~code.between(0xD800, 0xDFFF)
        char = F.when(valid, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")).when(code.isNotNull(), "\ufffd")
        char = F.coalesce(F.try_element_at(named, ref), char)
        whole = (i > 0) & F.contains(p, F.lit(";")) & char.isNotNull()
        rest = F.substr(p, F.length(ref) + 2)
        return F.when(whole, F.concat(char, rest)).when(i > 0, F.concat(F.lit("&"), p)).otherwise(p)

    return F.array_join(F.transform(F.split(c, "&", -1), piece), "")


def cell_text(c: Column) -> Column:
    """Tags become spaces, character references are decoded, whitespace collapses."""
    return X.clean(unescaped(F.regexp_replace(c, r"(?s)<!--.*?-->|<[^>]*>", " ")))


def header_names(cells: Column) -> Column:
    """Cleaned header texts: runs outside word or CJK characters become one underscore."""

    def name(c: Column, i: Column) -> Column:
        safe = F.regexp_replace(F.regexp_replace(c, r"(?U)[^\w\x{4e00}-\x{9fff}]+", "_"), r"^_+|_+$", "")
        return F.when(safe == "", F.concat(F.lit("col_"), (i + 1).cast("string"))).otherwise(safe)

    return F.transform(cells, name)


def header_suffix(names: Column) -> Column:
    """The n-th repeat of a name gets _n, n being its place among its equals in sorted order."""

    def suffixed(s: Column, flat: Column, c: Column, i: Column) -> Column:
        n = F.array_position(s, F.struct(c.alias("n"), i.alias("i"))) - F.array_position(flat, c) + 1
        return F.when(n > 1, F.concat(c, F.lit("_"), n.cast("string"))).otherwise(c)

    ordered = F.array_sort(F.transform(names, lambda c, i: F.struct(c.alias("n"), i.alias("i"))))
    return bind(ordered, lambda s: bind(F.transform(s, lambda x: x["n"]), lambda flat: F.transform(names, lambda c, i: suffixed(s, flat, c, i))))


# What a tag does, in the order that the step below compares by.
CELL, CELL_END, ROW, ROW_END, SECTION, TABLE_END, TABLE = range(1, 8)
EFFECTS = {
    "td": CELL, "th": CELL, "/td": CELL_END, "/th": CELL_END, "tr": ROW, "/tr": ROW_END, "thead": SECTION, "tbody": SECTION, "tfoot": SECTION,
    "/thead": SECTION, "/tbody": SECTION, "/tfoot": SECTION, "/table": TABLE_END, "table": TABLE,
}
ELEMENT = "array<struct<open:int,close:int,first:int,last:int>>"
LEVELS = "array<struct<tr:int,first:int,td:int>>"


def effect(tag: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in EFFECTS.items() for x in pair]), F.lower(tag))


def _span(from_: Column, to: Column, first: Column, last: Column) -> Column:
    return F.struct(from_.alias("open"), to.alias("close"), first.alias("first"), last.alias("last"))


def _state(s: Column, **changed: Column) -> Column:
    names = ["depth", "below", "tr", "first", "td", "cells", "out"]
    return F.struct(*[changed.get(n, s[n]).alias(n) for n in names])


def _step(s: Column, e: Column, i: Column) -> Column:
    """One tag after another: what is open in the innermost table and in those around it, and what the tag closes.

    A table knows its open row (where it began, and how many cells there were before it)
    and its open cell. A cell ends at the next cell, row or section of its own table, or
    at its end tag; a row at the next row or section; a table ends whatever it holds.
    A finished cell is a span whose ``first`` is -1; a row's are its cells' numbers.
    """
    out = s["out"]
    ends_cell = (s["td"] >= 0) & (e <= TABLE_END)
    ends_row = (e >= ROW) & (e <= TABLE_END)
    row_done = ends_row & (s["tr"] >= 0)
    cell_span = F.array(_span(s["td"], i, F.lit(-1), F.lit(0)))
    row_span = F.array(_span(s["tr"], i, s["first"], s["cells"]))
    finished = (
        F.when(ends_cell & row_done, F.concat(out, cell_span, row_span)).when(ends_cell, F.concat(out, cell_span)).when(row_done, F.concat(out, row_span)).otherwise(out)
    )
    inside = _state(
        s,
        tr=F.when(e == ROW, i).when(ends_row, F.lit(-1)).otherwise(s["tr"]),
        first=F.when(e == ROW, s["cells"]).otherwise(s["first"]),
        td=F.when(e == CELL, i).when(ends_cell, F.lit(-1)).otherwise(s["td"]),
        cells=s["cells"] + F.when(e == CELL, 1).otherwise(0),
        out=finished,
    )
    around = F.struct(s["tr"].alias("tr"), s["first"].alias("first"), s["td"].alias("td"))
    opened = _state(s, depth=s["depth"] + 1, below=F.concat(s["below"], F.array(around)), tr=F.lit(-1), first=F.lit(0), td=F.lit(-1))
    up = F.get(s["below"], s["depth"] - 2)
    rest = F.slice(s["below"], F.lit(1), F.greatest(s["depth"] - 2, F.lit(0)))
    left = _state(s, depth=s["depth"] - 1, below=rest, tr=F.coalesce(up["tr"], F.lit(-1)), first=F.coalesce(up["first"], F.lit(0)), td=F.coalesce(up["td"], F.lit(-1)), out=finished)
    # Behind the end of the outer table nothing counts.
    return F.when(s["depth"] == 0, s).when(e < TABLE_END, inside).when(e == TABLE, opened).otherwise(left)


def _elements(effects: Column, n: Column) -> Column:
    """struct<out, closed>: rows and cells of the outer table as spans of tags, and whether it ends.

    Tags are folded in runs, so that finished elements are copied within their run only.
    """
    none = F.array().cast(ELEMENT)
    values = [F.lit(1), F.array().cast(LEVELS), F.lit(-1), F.lit(0), F.lit(-1), F.lit(0), F.array().cast(f"array<{ELEMENT}>")]
    start = F.struct(*[v.alias(k) for v, k in zip(values, ["depth", "below", "tr", "first", "td", "cells", "out"], strict=True)])

    def run(s: Column, r: Column) -> Column:
        part = F.transform(F.slice(effects, r * RUN + 1, F.lit(RUN)), lambda e, j: F.struct(e.alias("e"), (r * RUN + j).cast("int").alias("i")))
        done = F.aggregate(part, _state(s, out=none), lambda q, x: _step(q, x["e"], x["i"]))
        return bind(done, lambda d: _state(d, out=F.concat(s["out"], F.array(d["out"]))))

    runs = F.when(n > 0, F.sequence(F.lit(0), F.floor((n - 1) / RUN).cast("int"))).otherwise(F.array().cast("array<int>"))
    folded = F.aggregate(runs, start, run)

    def ended(d: Column) -> Column:
        around = F.struct(d["tr"].alias("tr"), d["first"].alias("first"), d["td"].alias("td"))
        levels = F.when(d["depth"] > 0, F.concat(d["below"], F.array(around))).otherwise(F.array().cast(LEVELS))
        cells = F.transform(F.filter(levels, lambda v: v["td"] >= 0), lambda v: _span(v["td"], n, F.lit(-1), F.lit(0)))
        rows = F.transform(F.filter(levels, lambda v: v["tr"] >= 0), lambda v: _span(v["tr"], n, v["first"], d["cells"]))
        return F.struct(F.concat(F.flatten(d["out"]), cells, rows).alias("out"), (d["depth"] == 0).alias("closed"))

    return bind(folded, ended)


def table_grid(html: Column) -> Column:
    """struct<rows: array<array<string>>, closed>: cell texts by row of the first table.

    Every row counts, those of nested tables too; a row's cells are all cells that begin in
    it, and a cell's text is all text in it. So a cell that holds a table keeps its own
    row whole, and is followed there by the cells it holds. Cells outside rows are left out.
    """
    body = F.regexp_replace(F.translate(F.coalesce(html, F.lit("")), "\x01\x02", ""), r"(?s)<!--.*?-->", " ")
    marked = F.regexp_replace(body, PART, "\x01$1$2\x02")
    pieces = F.split(marked, "\x01")

    def grid(p: Column) -> Column:
        tags = F.transform(p, lambda x: F.lower(F.substring_index(x, "\x02", 1)))
        first = F.array_position(F.slice(tags, F.lit(2), F.size(p)), "table").cast("int")  # the piece before any tag does not count
        rest = F.slice(p, first + 2, F.size(p))
        return F.when((F.size(p) > 1) & (first > 0), bind(rest, lambda q: inside(q))).otherwise(F.lit(None))

    def inside(q: Column) -> Column:
        effects = F.transform(q, lambda x: effect(F.substring_index(x, "\x02", 1)))
        texts = F.transform(q, lambda x: F.substring(x, F.instr(x, "\x02") + 1, F.length(x)))
        return bind(effects, lambda t: bind(texts, lambda x: bind(_elements(t, F.size(t)), lambda e: laid_out(x, e))))

    def laid_out(texts: Column, e: Column) -> Column:
        spans = F.array_sort(F.filter(e["out"], lambda x: x["first"] < 0))
        cells = F.transform(spans, lambda c: cell_text(F.when(c["close"] == c["open"] + 1, F.get(texts, c["open"])).otherwise(F.array_join(F.slice(texts, c["open"] + 1, c["close"] - c["open"]), " "))))
        rows = F.array_sort(F.filter(e["out"], lambda x: x["first"] >= 0))
        return bind(cells, lambda c: F.struct(F.transform(rows, lambda r: F.slice(c, r["first"] + 1, r["last"] - r["first"])).alias("rows"), e["closed"].alias("closed")))

    return bind(pieces, grid)


def cell_kind(raw: Column) -> Column:
    """null, percent, long, double or text; ``raw`` is cleaned cell text."""
    # Cells accepted by a float() reading: decimal or exponent forms, signs, inf and nan.
    number = r"(?i)^\s*[+-]?(\d+\.?\d*([e][+-]?\d+)?|\.\d+([e][+-]?\d+)?|inf(inity)?|nan)\s*%$"
    return (
        F.when(F.lower(raw).isin(*NULL_CELLS), "null")
        .when(raw.rlike(number), "percent")
        .when(raw.rlike(r"^-?\d+$"), "long")
        .when(raw.rlike(r"^-?\d+\.\d+$"), "double")
        .otherwise("text")
    )


def cell_number(raw: Column) -> Column:
    return F.regexp_replace(raw, r"\s*%$", "").try_cast("double")


def cell_string(raw: Column, kind: Column) -> Column:
    """A cell in a text column: numbers print as they parse, a percent as its float."""
    shown = cell_number(raw).cast("string")
    whole = F.regexp_replace(F.regexp_replace(raw, r"^(-?)0+(?=\d)", "$1"), r"^-0$", "0")
    return F.when(kind == "null", F.lit(None).cast("string")).when(kind.isin("percent", "double"), shown).when(kind == "long", whole).otherwise(raw)


def column_type(kinds: Column) -> Column:
    """Type of a column from its cell kinds: an all-null column is boolean."""
    none, whole = (lambda k: k == "null"), (lambda k: k.isin("null", "long"))
    number = lambda k: k.isin("null", "long", "double", "percent")
    return (
        F.when(F.forall(kinds, none), "boolean")
        .when(F.forall(kinds, whole), "long")
        .when(F.forall(kinds, number), "double")
        .otherwise("string")
    )


def parsed_tables(tables: DataFrame, html: str = "html") -> DataFrame:
    """Adds headers, rows (cleaned cells, padded to the header width, blank rows
    dropped), types and malformed (the table has no end) to each table row. Only the
    first table counts.

    Each step is bound once, so no later filter or projection repeats the parse.
    """

    def table(g: Column) -> Column:
        c = F.coalesce(g["rows"], F.array().cast("array<array<string>>"))
        first = F.coalesce(F.get(c, F.lit(0)), F.array().cast("array<string>"))
        return bind(header_names(first), lambda n: bind(header_suffix(n), lambda h: with_headers(g, c, h)))

    def with_headers(g: Column, c: Column, h: Column) -> Column:
        later = F.slice(c, F.lit(2), F.greatest(F.size(c) - 1, F.lit(0)))
        full = F.filter(later, lambda r: F.exists(r, lambda x: x != ""))
        padded = F.transform(full, lambda r: F.transform(h, lambda _, i: F.coalesce(F.get(r, i), F.lit(""))))
        return bind(padded, lambda rows: with_rows(g, h, rows))

    def with_rows(g: Column, h: Column, rows: Column) -> Column:
        types = F.transform(h, lambda _, i: bind(F.transform(rows, lambda r: cell_kind(F.get(r, i))), column_type))
        malformed = F.coalesce(~g["closed"], F.lit(False))
        return F.struct(h.alias("headers"), rows.alias("rows"), types.alias("types"), malformed.alias("malformed"))

    read = settled(tables, {"_g": table_grid(F.col(html))})
    return settled(read, {"_p": bind(F.col("_g"), table)}).select(*tables.columns, "_p.*")


def html_cells(parsed: DataFrame, keys: list[str]) -> DataFrame:
    """Long form: keys, row, col (0-based), header, raw, kind, malformed."""
    return (
        parsed.select(*keys, "headers", "malformed", F.posexplode("rows").alias("row", "_r"))
        .select(*keys, "headers", "malformed", "row", F.posexplode("_r").alias("col", "raw"))
        .select(*keys, "row", "col", F.get("headers", F.col("col")).alias("header"), "raw", cell_kind(F.col("raw")).alias("kind"), "malformed")
    )


def table_column_types(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Column types by aggregation over long cells, for cells that are already stored."""
    agg = cells.groupBy(*keys, "col", "header").agg(
        F.bool_and(F.col("kind") == "null").alias("_n"),
        F.bool_and(F.col("kind").isin("null", "long")).alias("_l"),
        F.bool_and(F.col("kind").isin("null", "long", "double", "percent")).alias("_d"),
    )
    kind = F.when(F.col("_n"), "boolean").when(F.col("_l"), "long").when(F.col("_d"), "double").otherwise("string")
    return agg.select(*keys, "col", "header", kind.alias("type"))


def typed_cells(parsed: DataFrame, keys: list[str]) -> DataFrame:
    """Long cells with their typed value columns (long_value, double_value, string_value)."""
    cells = parsed.select(*keys, "headers", "types", F.posexplode("rows").alias("row", "_r")).select(
        *keys, "headers", "types", "row", F.posexplode("_r").alias("col", "raw")
    )
    c = cells.select(
        *keys, "row", "col", F.get("headers", F.col("col")).alias("header"), F.get("types", F.col("col")).alias("type"),
        "raw", cell_kind(F.col("raw")).alias("kind"),
    )
    present = F.col("kind") != "null"
    return c.select(
        *keys, "row", "col", "header", "type",
        F.when(present & (F.col("type") == "long"), F.col("raw").try_cast("bigint")).alias("long_value"),
        F.when(present & (F.col("type") == "double"), cell_number(F.col("raw"))).alias("double_value"),
        F.when(present & (F.col("type") == "string"), cell_string(F.col("raw"), F.col("kind"))).alias("string_value"),
    )


def table_shape(parsed: DataFrame, keys: list[str]) -> DataFrame:
    return parsed.select(*keys, F.array_join("headers", "|").alias("columns"), F.size("rows").alias("row_count"))


def table_preview(cells: DataFrame, keys: list[str], n: int = 8) -> DataFrame:
    """Cells of the first ``n`` records of each table."""
    return cells.filter(F.col("row") < n)


def table_ids(table_blocks: DataFrame) -> DataFrame:
    """table_ + 6-digit position among the document's table blocks by (page, order)."""
    ranked = dense_position(table_blocks, ["document_id"], "page_no", "reading_order", ["id"], "table_index")
    return ranked.withColumn("table_id", F.format_string("table_%06d", F.col("table_index") + 1))


def table_record_build(parsed: DataFrame) -> DataFrame:
    """payload, provenance and validation of each table block.

    ``parsed`` has document_id, table_id, id, page_no, bbox_norm, text, title,
    description, headers, rows. The title falls back to a caption line.
    """
    title = F.col("title")
    entry = lambda f, c: F.when(X.truthy(c).isNotNull(), F.array().cast("array<struct<field:string,missing_reason:string>>")).otherwise(
        F.array(F.struct(F.lit(f).alias("field"), F.lit("source_not_present").alias("missing_reason")))
    )
    image = F.concat(F.lit("images/"), "table_id", F.lit(".png"))
    return parsed.select(
        "document_id",
        "table_id",
        F.struct(
            "table_id",
            F.concat(F.lit("tables/"), "table_id", F.lit(".parquet")).alias("table_path"),
            title.alias("table_title"),
            F.col("description").alias("table_description"),
            image.alias("source_image_path"),
        ).alias("payload"),
        F.struct(
            "page_no",
            F.col("bbox_norm").alias("bbox"),
            F.lit("table").alias("source_type"),
            F.coalesce("text", F.lit("")).alias("source_text"),
            image.alias("source_image_path"),
            F.col("id").alias("block_id"),
        ).alias("provenance"),
        F.struct(
            F.lit(True).alias("schema_valid"),
            F.lit("table.v1").alias("schema_version"),
            F.size("rows").alias("row_count"),
            F.col("headers").alias("columns"),
            F.concat(entry("table_title", title), entry("table_description", F.col("description"))).alias("missing"),
        ).alias("validation"),
    )


def with_titles(table_blocks: DataFrame, answers: DataFrame | None = None) -> DataFrame:
    """title and description: from an answer's JSON when it reads, else a caption line."""
    if answers is None:
        return table_blocks.withColumns({"title": X.caption_line(F.col("text")), "description": F.lit(None).cast("string")})
    a = answers.select("document_id", "table_id", X.loose_json(F.col("answer_text")).alias("_a"))
    read = F.col("_a").isNotNull() & ~F.is_variant_null("_a")
    return (
        table_blocks.join(a, ["document_id", "table_id"], "left")
        .withColumn("title", F.when(read, F.try_variant_get("_a", "$.table_title", "string")).otherwise(X.caption_line(F.col("text"))))
        .withColumn("description", F.when(read, F.try_variant_get("_a", "$.table_description", "string")))
        .drop("_a")
    )


def upsert_table_records(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Stored rows after saving ``new`` by (document_id, table_id).

    A hit keeps id and created_at and takes the new JSON columns; its status
    becomes the supplied one or pending. New rows carry id and saved_at.
    """
    key = ["document_id", "table_id"]
    n = new.select(
        *key,
        *[F.col(c).alias(f"n_{c}") for c in ("id", "payload", "provenance", "validation", "review_status")],
        F.col("saved_at"),
        F.lit(True).alias("_hit"),
    )
    hit = F.coalesce("_hit", F.lit(False))
    return stored.join(n, key, "full_outer").select(
        F.coalesce("id", "n_id").alias("id"),
        *key,
        *[F.when(hit, F.col(f"n_{c}")).otherwise(F.col(c)).alias(c) for c in ("payload", "provenance", "validation")],
        F.when(hit, F.coalesce("n_review_status", F.lit("pending"))).otherwise(F.col("review_status")).alias("review_status"),
        F.coalesce("created_at", "saved_at").alias("created_at"),
        F.when(hit, F.col("saved_at")).otherwise(F.col("updated_at")).alias("updated_at"),
    )


def save_table_records(spark: SparkSession, stored: versioned.Table, new: DataFrame) -> int:
    """Upsert into a stored table keyed by (document_id, table_id): only hit keys are read, only saved ones written."""
    current = versioned.read(spark, stored, new.select(*stored.key))
    return versioned.commit(spark, stored, upsert_table_records(current, new))


KINDS = {"boolean": "boolean", "long": "bigint", "double": "double", "string": "string"}
SCHEMA_BUCKETS = 64


def _last(names: Column, c: Column) -> Column:
    """Place of the last column of a name."""
    return (F.size(names) - F.array_position(F.reverse(names), c)).cast("int")


def typed_store(parsed: DataFrame, keys: list[str], buckets: int = SCHEMA_BUCKETS) -> DataFrame:
    """Rows of typed tables of any number of schemas, in one pass.

    Each table gives a head row (``row`` null: columns, types, row_count) and one row per
    record with a variant of its typed values. Of columns that share a name the last one's
    values count; a table without records has a head only. ``schema_id`` is the digest of
    columns and types, ``bucket`` its remainder, by which the rows are to be laid out.
    """
    columns = F.when(F.size("rows") > 0, F.array_distinct("headers")).otherwise(F.array().cast("array<string>"))
    d = settled(parsed, {"columns": columns})
    d = settled(d, {"_at": F.transform("columns", lambda c: _last(F.col("headers"), c))})
    d = settled(d, {"_kinds": F.transform("_at", lambda i: F.get("types", i))})
    digest = F.sha2(F.to_json(F.struct(F.col("columns").alias("c"), F.col("_kinds").alias("t"))), 256)
    d = settled(d, {"schema_id": digest, "_n": F.size("rows")})

    def value(raw: Column, kind: Column) -> Column:
        k = cell_kind(raw)
        typed = (
            F.when(kind == "long", raw.try_cast("bigint").cast("variant"))
            .when(kind == "double", cell_number(raw).cast("variant"))
            .when(kind == "string", cell_string(raw, k).cast("variant"))
        )
        return F.when(k != "null", typed)

    def values(r: Column) -> Column:
        cells = F.transform(F.arrays_zip(F.col("_at").alias("i"), F.col("_kinds").alias("k")), lambda z: bind(F.get(r, z["i"]), lambda raw: value(raw, z["k"])))
        return F.to_variant_object(F.map_from_arrays("columns", cells))

    kind = "array<struct<row:int,columns:array<string>,types:array<string>,row_count:int,cells:array<string>>>"
    none = F.lit(None)
    head = F.array(F.struct(none.alias("row"), F.col("columns").alias("columns"), F.col("_kinds").alias("types"), F.col("_n").alias("row_count"), none.alias("cells"))).cast(kind)
    body = F.transform("rows", lambda r, i: F.struct(i.alias("row"), none.alias("columns"), none.alias("types"), none.alias("row_count"), r.alias("cells"))).cast(kind)
    bucket = F.pmod(F.xxhash64("schema_id"), F.lit(buckets)).cast("int").alias("bucket")
    rows = d.select(*keys, "schema_id", bucket, "columns", "_at", "_kinds", F.explode(F.concat(head, body)).alias("_r"))
    return rows.select(
        *keys, "schema_id", "_r.row", F.col("_r.columns").alias("columns"), F.col("_r.types").alias("types"), F.col("_r.row_count").alias("row_count"),
        F.when(F.col("_r.cells").isNotNull(), values(F.col("_r.cells"))).alias("values"), "bucket",
    )


def write_typed_tables(parsed: DataFrame, keys: list[str], path: str, buckets: int = SCHEMA_BUCKETS) -> None:
    """All tables' typed rows as Parquet by bucket of the schema: one job, whatever schemas there are."""
    rows = typed_store(parsed, keys, buckets).hint("rebalance", "bucket").sortWithinPartitions("bucket", "schema_id", *keys, F.col("row").asc_nulls_first())
    rows.write.mode("overwrite").partitionBy("bucket").parquet(path)


def table_schemas(stored: DataFrame) -> DataFrame:
    """Schemas of a typed store with their numbers of tables and records."""
    heads = stored.where("row is null")
    return heads.groupBy("schema_id", "bucket").agg(F.first("columns").alias("columns"), F.first("types").alias("types"), F.count(F.lit(1)).alias("tables"), F.sum("row_count").alias("records"))


def widened(stored: DataFrame, keys: list[str], columns: list[tuple[str, str]], buckets: int = SCHEMA_BUCKETS) -> DataFrame:
    """Typed columns of every table of one schema; other buckets' folders are not read."""
    names, kinds = [n for n, _ in columns], [k for _, k in columns]
    text = F.to_json(F.struct(F.array(*map(F.lit, names)).alias("c"), F.array(*map(F.lit, kinds)).alias("t")))
    sid, bucket = stored.sparkSession.range(1).select(F.sha2(text, 256).alias("s")).select("s", F.pmod(F.xxhash64("s"), F.lit(buckets)).cast("int")).first()
    rows = stored.where((F.col("bucket") == bucket) & (F.col("schema_id") == sid) & F.col("row").isNotNull())

    def read(n: str, k: str) -> Column:
        quoted = n.replace("\\", "\\\\").replace('"', '\\"')
        return F.try_variant_get("values", f'$["{quoted}"]', KINDS[k]).alias(n)

    return rows.select(*keys, "row", *[read(n, k) for n, k in columns])
