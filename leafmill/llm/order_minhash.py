"""Order MinHash fingerprints by DataFrame functions alone.

A text's tokens are its words; a word of more than 16 characters counts as pieces of
16, so that text without spaces has an order too. Its k-mers are runs of ``k`` tokens
(all tokens, if fewer), each numbered by its occurrence in the text. Every slot of the
fingerprint has ``TUPLE`` fixed keys; for each key the numbered k-mer whose hash is
nearest to it (their exclusive or is least) is selected, which is a minimum under a
permutation of its own. The selected k-mers are put in text order and their hashes
are hashed to the slot's value: it agrees between two texts if they share the selected
k-mers and their order. The likeness of two fingerprints is the share of equal slots.

Neighbours are found on keys and lengths. Texts move between machines once, to their
row's key, and their first quarters once more, to the row before; tokens stay where their
text is, sorted by (row, k-mer) inside the partition to number the occurrences.

Defined results: a null text is the empty text, whose slots hold one fixed value; rows
that repeat id and text are worked out once and returned as often as they occur; an empty
table gives an empty table; further columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.session import materialize

SLOTS = 24
TUPLE = 2
K = 3
PIECE = r"[^\x20\x09-\x0D]{1,16}"
PLACE_BITS = 30
EMPTY = "0" * 8
WIDER = 4


def _keys(n: int) -> list[int]:
    """n fixed 64-bit numbers, spread evenly by the golden ratio."""
    return [((i * 0x9E3779B97F4A7C15) % 2**64) - 2**63 for i in range(1, n + 1)]


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(PIECE), F.lit(0))


def fingerprints(texts: DataFrame, keys: list[str], text_col: str, k: int = K, slots: int = SLOTS) -> DataFrame:
    """(keys..., fingerprint) for rows that are already partitioned by the first of ``keys``.

    ``fingerprint`` has eight hexadecimal digits a slot. Texts without tokens give no row.
    """
    words = texts.select(*keys, tokens(F.col(text_col)).alias("w"))
    shifted = [F.col("w"), *(F.slice("w", j + 1, F.greatest(F.size("w") - j, F.lit(0))) for j in range(1, k))]
    names = [f"w{j}" for j in range(k)]
    zipped = F.arrays_zip(*(c.alias(n) for c, n in zip(shifted, names, strict=True)))
    flat = words.select(*keys, F.posexplode(zipped).alias("at", "t"))
    parts = [F.col("t").getField(names[j]) for j in range(k)]
    mers = flat.where(parts[-1].isNotNull() | (F.col("at") == 0)).select(*keys, "at", F.xxhash64(*parts).alias("mer"))
    numbered = mers.withColumn("nth", F.row_number().over(Window.partitionBy(*keys, "mer").orderBy("at"))).withColumn("h", F.xxhash64("mer", "nth"))
    mask = F.lit(-(1 << PLACE_BITS)).cast("long")
    place = F.col("at").cast("long").bitwiseAND(F.lit((1 << PLACE_BITS) - 1).cast("long"))
    least = [F.min(F.col("h").bitwiseXOR(F.lit(c)).bitwiseAND(mask).bitwiseOR(place)).alias(f"m{i}") for i, c in enumerate(_keys(slots * TUPLE))]
    return numbered.groupBy(*keys).agg(*least).select(*keys, _slots(slots).alias("fingerprint"))


def _slots(slots: int) -> Column:
    """Each slot's selected k-mers in text order, hashed to eight digits."""
    out = []
    low = F.lit((1 << PLACE_BITS) - 1).cast("long")
    for s in range(slots):
        picked = F.array_sort(
            F.array(*(F.struct(F.col(f"m{s * TUPLE + i}").bitwiseAND(low).alias("at"), F.shiftright(F.col(f"m{s * TUPLE + i}"), PLACE_BITS).alias("id"), F.lit(i).alias("key")) for i in range(TUPLE)))
        )
        out.append(F.lpad(F.hex(F.xxhash64(*(picked[i]["id"] for i in range(TUPLE)), *(picked[i]["key"] for i in range(TUPLE))).bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0"))
    return F.lower(F.concat(*out))


def likeness(a: Column, b: Column, slots: int = SLOTS) -> Column:
    """The share of slots in which two fingerprints agree."""
    same = F.lit(0)
    for s in range(slots):
        same = same + (F.substring(a, 8 * s + 1, 8) == F.substring(b, 8 * s + 1, 8)).cast("int")
    return same / F.lit(float(slots))


def with_neighbours(rows: DataFrame) -> DataFrame:
    """``rows`` (row, doc_id, n, copies) by ascending id, each with what the row before it is; the last comes before the first.

    Rows are ranged over partitions by id, written so, and ordered inside each. Only the
    last row of each partition meets the others' in one task.
    """
    order = [F.col("doc_id").asc_nulls_first(), "row"]
    ranged = materialize(rows.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "order-minhash-ranges")
    own = F.struct("row", "n", "copies", F.col("doc_id").alias("id"))
    inner = ranged.withColumn("prev", F.lag(own).over(Window.partitionBy("part").orderBy(*order)))
    ends = ranged.groupBy("part").agg(F.max_by(own, F.struct(F.col("doc_id").isNotNull(), "doc_id", "row")).alias("last"))
    across = Window.partitionBy(F.lit(0)).orderBy("part")
    whole = Window.partitionBy(F.lit(0))
    bridge = ends.select("part", F.coalesce(F.lag("last").over(across), F.max_by("last", "part").over(whole)).alias("before"))
    return inner.join(bridge, "part").select("row", "doc_id", "n", "copies", F.coalesce("prev", "before").alias("prev"))


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(row, doc_id, text): the key is a digest of id and text, so equal rows share it."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    named = F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("-")), F.lit(":"), text)
    return docs.select(F.unhex(F.md5(named)).alias("row"), F.col(id_col).alias("doc_id"), text.alias("text"))


def _counted(keyed: DataFrame) -> DataFrame:
    return keyed.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.max(F.length("text")).alias("n"), F.count(F.lit(1)).alias("copies"))


def _texts(keyed: DataFrame) -> DataFrame:
    """(row, text) once for each key, partitioned by it. Always these columns, so that the exchange is made once.

    A text's tokens take several times its room where they are sorted, hence the more partitions.
    """
    parts = WIDER * int(keyed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return keyed.select("row", "text").repartition(parts, "row").dropDuplicates(["row"])


def order_minhash(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, slots: int = SLOTS) -> DataFrame:
    """(id, fingerprint) of every document."""
    keyed = _keyed(docs, id_col, text_col)
    prints = fingerprints(_texts(keyed), ["row"], "text", k, slots)
    rows = _counted(keyed).withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return rows.join(prints, "row", "left").select(F.col("doc_id").alias(id_col), F.coalesce("fingerprint", F.lit(EMPTY * slots)).alias("fingerprint"))


def _edited(head: Column) -> Column:
    n = F.length("text")
    return F.concat(F.substring("text", F.lit(1), n - (n / 4).cast("int")), head)


def edit_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, slots: int = SLOTS) -> DataFrame:
    """Fingerprints of every text, of its edited text, and how like they are to it and to the next text's.

    The edited text has its last quarter of code points replaced by the first as many
    (or all) of the next document by ascending id, the first one after the last. Rows
    that repeat id and text follow one another: all but the last of them have themselves
    for the next document. Rows that share an id only are in the order of their digests.
    """
    keyed = _keyed(docs, id_col, text_col)
    placed = materialize(with_neighbours(_counted(keyed)).select("row", "prev"), "order-minhash-places")
    texts = _texts(keyed)
    heads = texts.join(placed.select("row", "prev").hint("merge"), "row").select(
        F.col("prev.row").alias("row"), F.col("row").alias("next_row"), F.col("prev.id").alias("doc_id"), F.col("prev.copies").alias("copies"), F.substring("text", F.lit(1), (F.col("prev.n") / 4).cast("int")).alias("head")
    )
    own = F.substring("text", F.lit(1), (F.length("text") / 4).cast("int"))
    again = F.when(F.col("copies") > 1, _edited(own))
    both = texts.join(heads.hint("merge"), "row").select("row", "next_row", "doc_id", "copies", "text", _edited(F.col("head")).alias("edited"), again.alias("again"))
    kinds = ("text", "edited", "again")
    sides = both.select("row", F.explode(F.array(*(F.struct(F.lit(i).alias("side"), F.col(c).alias("text")) for i, c in enumerate(kinds)))).alias("s")).where("s.text is not null")
    prints = fingerprints(sides.select("row", "s.side", "s.text"), ["row", "side"], "text", k, slots)
    by_row = prints.groupBy("row").agg(*(F.max(F.when(F.col("side") == i, F.unhex("fingerprint"))).alias(f"print_{c}") for i, c in enumerate(kinds)))
    facts = both.select("row", "next_row", "doc_id", "copies", F.length("text").cast("long").alias("n_chars"), F.unhex(F.sha2("edited", 256)).alias("sha_edited"), F.unhex(F.sha2("again", 256)).alias("sha_again"))
    # Digests and fingerprints travel as bytes and are spelt out at the end.
    none = F.unhex(F.lit(EMPTY * slots))
    known = facts.join(by_row, "row", "left").withColumns({f"print_{c}": F.coalesce(f"print_{c}", none) for c in kinds})
    known = materialize(known, "order-minhash")
    following = known.select(F.col("row").alias("next_row"), F.col("print_text").alias("next_print"))
    found = known.join(following, "next_row")

    def version(kind: str, next_print: Column) -> Column:
        return F.struct(F.col(f"sha_{kind}").alias("sha"), F.col(f"print_{kind}").alias("edited"), next_print.alias("next"))

    repeats = F.array_repeat(version("again", F.col("print_text")), (F.col("copies") - 1).cast("int"))
    rows = found.withColumn("v", F.explode(F.concat(F.array(version("edited", F.col("next_print"))), repeats)))
    spelt = lambda c: F.lower(F.hex(c))
    rows = rows.select("doc_id", "n_chars", spelt("v.sha").alias("sha"), spelt("print_text").alias("own"), spelt("v.edited").alias("edited"), spelt("v.next").alias("next"))
    return rows.select(
        F.col("doc_id").alias(id_col),
        "n_chars",
        F.col("sha").alias("edited_sha256"),
        F.col("own").alias("fingerprint"),
        F.col("edited").alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("edited"), slots).alias("near_edited"),
        likeness(F.col("own"), F.col("next"), slots).alias("near_next"),
    )
