"""N-gram Jaccard join by count vectors.

A document is the set of its hashed shingles; documents with equal sets form a class.
Shingles are hashed into groups, and two sets with a Jaccard similarity of t or more
differ in at most D = (1 - t) / t * size shingles, hence in at most D groups' contents.
Of the groups' contents, ordered by their own hash, each document therefore posts its
D + 1 least: two linked documents always have one of these postings in common. That
routes documents to buckets without comparing all with all. Group numbers depend on a
size band (powers of two); a document just above a band's lower bound posts in the
band below as well.

A bucket's members are points of an R-tree: coordinate i counts the member's shingles
in the i-th of COORDINATES equal hash ranges. The sum of coordinate minima bounds the
overlap, of two points or of a point and a node's upper corner; pairs that the bound
lets through are verified on the sets themselves. Buckets with the same least member are
one, so that a pair that shares many postings is met a few times at most. In each of some
rounds a document is compared with the least member it shares most postings with, and
links join components. Then buckets that still hold several components search their
R-trees across components, large buckets in blocks of members, and tell which members
have a partner left; these members' sets come to the bucket's task, which verifies the
likeliest pairs first and skips those it has already joined. So a task emits fewer links
than members, no pair ever becomes a row, and pairs inside one component need no test.

Defined results: null, empty and blank texts have no shingles and are linked with
nothing, each row by itself; a text with fewer words than ``width`` is one shingle;
repeated rows are copies; rows without an id take the id null and their class's
component; an empty table gives an empty table; further columns are not read. Shingles
and sets are compared by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.llm.graph import joined
from leafmill.llm.words import chunks, fresh, mix, powers, runs, split_words, tidy
from leafmill.session import materialize

COORDINATES = 512
COARSE = 64
LEAF = 32
BLOCK_MEMBERS, BLOCK_BYTES = 512, 1 << 24
ROUNDS = 3
GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def shingle_sets(texts: pa.Array, width: int) -> list[np.ndarray]:
    """Each text's sorted distinct shingle hashes; A-Z count as a-z."""
    words = split_words(texts)
    hashes = words.hashes(lower=True)
    whole, place = runs(words, hashes, width)
    cut = np.searchsorted(place, words.begin)
    factor = powers(width)
    out = []
    for i in range(len(words.begin) - 1):
        b, e = words.begin[i], words.begin[i + 1]
        if e - b >= width:
            out.append(np.unique(whole[cut[i] : cut[i + 1]]))
        elif e > b:
            out.append(mix(np.atleast_1d((hashes[b:e] * factor[: e - b]).sum(dtype=np.uint64) + np.uint64(e - b))))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def set_hash(shingles: np.ndarray) -> int:
    total = mix(shingles ^ GOLDEN).sum(dtype=np.uint64, keepdims=True) + np.array([len(shingles)], np.uint64) * GOLDEN
    return int(mix(total).view(np.int64)[0])


def point(shingles: np.ndarray) -> bytes:
    counts = np.bincount((shingles >> np.uint64(64 - 9)).astype(np.int64), minlength=COORDINATES)
    return np.minimum(counts, 65535).astype(np.uint16).tobytes()


def points_of(column: pa.Array) -> np.ndarray:
    """Points as a matrix; a count that filled its two bytes bounds nothing."""
    out = np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, COORDINATES).astype(np.int32)
    out[out == 65535] = 2**30 // COORDINATES
    return out


def postings(shingles: np.ndarray, share: int) -> list[int]:
    """Keys of the buckets a set meets its partners in; ``share`` is the similarity in hundredths."""
    n = len(shingles)
    if not n:
        return []
    differ = n * (100 - share) // share  # the most shingles that only one of two linked sets holds
    top = (shingles >> np.uint64(32)).astype(np.uint64)
    out = []
    band = n.bit_length()
    for k in (band, band - 1):
        # The band below is met by sizes whose smaller partners can lie there.
        if k == band - 1 and (k < 1 or n * share > ((1 << k) - 1) * 100):
            continue
        size = 1 << k
        groups = np.uint64(8 * size if size <= 64 else -(-3 * size // 10))
        group = (top * groups) >> np.uint64(32)
        first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        content = mix(np.add.reduceat(mix(shingles + GOLDEN), first) + group[first] * GOLDEN + np.uint64(k))
        out += np.sort(content)[: differ + 1].view(np.int64).tolist()
    return out


def _facts(width: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, "text"):
            sets = shingle_sets(part.column("text"), width)
            yield pa.RecordBatch.from_pydict(
                {
                    "id": part.column("id"),
                    "n": pa.array([len(s) for s in sets], pa.int64()),
                    "s": pa.array([set_hash(s) if len(s) else None for s in sets], pa.int64()),
                    "point": pa.array([point(s) if len(s) else None for s in sets], pa.binary()),
                }
            )

    return task


def _postings(width: int, share: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # copies in the same task post once
        for part in chunks(batches, "text"):
            keys, owners = [], []
            for s in shingle_sets(part.column("text"), width):
                if len(s) and (h := set_hash(s)) not in seen:
                    seen.add(h)
                    own = postings(s, share)
                    keys += own
                    owners += [h] * len(own)
            yield pa.RecordBatch.from_pydict({"key": pa.array(keys, pa.int64()), "s": pa.array(owners, pa.int64())})

    return task


def _grouped(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[pa.RecordBatch]:
    """Batches of a sorted partition, cut so that rows equal in ``names`` stay together."""
    rest: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([*rest, batch]).combine_chunks()
        last = np.ones(table.num_rows, bool)
        for c in names:
            v = table[c].to_numpy()
            last &= v == v[-1]
        cut = table.num_rows - int(np.argmin(last[::-1])) if not last.all() else 0
        if cut:
            yield table.slice(0, cut).combine_chunks().to_batches()[0]
        rest = table.slice(cut).combine_chunks().to_batches()
    if rest:
        yield pa.Table.from_batches(rest).combine_chunks().to_batches()[0]


def _starts(*columns: np.ndarray) -> np.ndarray:
    change = np.zeros(len(columns[0]), bool)
    change[:1] = True
    for c in columns:
        change[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(change)


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by (key, s): members of buckets with two or more, and the least one."""
    for batch in _grouped(batches, ["key"]):
        key, s = batch.column("key").to_numpy(), batch.column("s").to_numpy()
        new = _starts(key, s)
        key, s = key[new], s[new]
        first = _starts(key)
        size = np.diff(np.append(first, len(key)))
        at = np.repeat(size, size) > 1
        yield pa.RecordBatch.from_pydict({"least": np.repeat(s[first], size)[at], "s": s[at]})


class RTree:
    """Points packed by size into leaves; a leaf keeps its upper corner and least size.

    Leaves and points are first judged on COARSE sums of neighbouring coordinates,
    then the points that are left on all coordinates.
    """

    def __init__(self, points: np.ndarray, sizes: np.ndarray):
        self.order = np.lexsort((points.argmax(1), sizes))
        self.points, self.sizes = points[self.order], sizes[self.order]
        self.coarse = coarse(self.points)
        first = np.arange(0, len(sizes), LEAF)
        self.corner = np.maximum.reduceat(self.coarse, first, 0)
        self.least = self.sizes[first]

    def search(self, q: np.ndarray, rough: np.ndarray, n: int, share: int) -> np.ndarray:
        """Places of the points whose overlap bound with q reaches the similarity."""
        # share <= 100 * overlap / (n + m - overlap), in whole numbers.
        fits = lambda bound, m: bound * (100 + share) >= share * (n + m)
        leaves = np.flatnonzero(fits(np.minimum(self.corner, rough).sum(1), self.least))
        if not len(leaves):
            return leaves
        at = (leaves[:, None] * LEAF + np.arange(LEAF)).ravel()
        at = at[at < len(self.sizes)]
        at = at[fits(np.minimum(self.coarse[at], rough).sum(1), self.sizes[at])]
        return self.order[at[fits(np.minimum(self.points[at], q).sum(1), self.sizes[at])]]


def coarse(points: np.ndarray) -> np.ndarray:
    return points.reshape(len(points), COARSE, -1).sum(2)


def _blocks(batches: Iterator[pa.RecordBatch], share: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """Of rows sorted by (least, block, other): batches, and each pair of blocks' pairs of
    different components that the bound lets through (overlap bound, place, place)."""
    for batch in _grouped(batches, ["least", "block", "other"]):
        least, block, other, mine, label, n = (batch.column(c).to_numpy() for c in ("least", "block", "other", "mine", "label", "n"))
        points = points_of(batch.column("point"))
        rough = coarse(points)
        bounds = np.append(_starts(least, block, other), len(least))
        out = []
        for b, e in zip(bounds[:-1], bounds[1:], strict=True):
            left = np.arange(b, e)[mine[b:e] == block[b]]
            right = left if block[b] == other[b] else np.arange(b, e)[mine[b:e] == other[b]]
            if not len(left) or not len(right) or (label[b:e] == label[b]).all():
                continue
            tree = RTree(points[right], n[right])
            found = []
            for i in left:
                at = right[tree.search(points[i], rough[i], n[i], share)]
                at = at[label[at] != label[i]]
                if right is left:
                    at = at[at > i]
                if len(at):
                    found.append(np.stack([np.minimum(points[at], points[i]).sum(1) * 200 // (n[at] + n[i]), np.full(len(at), i), at]))
            if found:
                out.append(np.concatenate(found, 1))
        yield batch, out


def _open(share: int):
    """Members with a possible partner in another component, by bucket."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, pairs in _blocks(batches, share):
            at = pa.array(np.unique(np.concatenate([p[1:].ravel() for p in pairs])) if pairs else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(c).take(at) for c in ("least", "s")], names=["least", "s"])

    return task


def _across(share: int):
    """Links that join components of a pair of blocks; a pair whose ends are joined by then needs no test."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, blocks in _blocks(batches, share):
            s, label, shingles = batch.column("s").to_numpy(), batch.column("label").to_numpy(), batch.column("shingles")
            out: list[tuple[int, int]] = []
            for pairs in blocks:
                joined: dict[int, int] = {}
                for i, j in pairs[1:, np.argsort(-pairs[0], kind="stable")].T.tolist():
                    a, b = root(joined, int(label[i])), root(joined, int(label[j]))
                    if a != b and linked(*(np.frombuffer(shingles[k].as_buffer(), np.uint64) for k in (i, j)), share):
                        joined[a] = b
                        out.append((s[i], s[j]))
            yield pa.RecordBatch.from_pydict({"a": pa.array([a for a, _ in out], pa.int64()), "b": pa.array([b for _, b in out], pa.int64())})

    return task


def root(joined: dict[int, int], x: int) -> int:
    while (up := joined.get(x, x)) != x:
        joined[x] = x = joined.get(up, up)
    return x


def linked(one: np.ndarray, two: np.ndarray, share: int) -> bool:
    small, large = (one, two) if len(one) < len(two) else (two, one)
    both = int((large[np.searchsorted(large, small).clip(0, len(large) - 1)] == small).sum())
    return 100 * both >= share * (len(one) + len(two) - both)


def _bounded(share: int):
    """Pairs whose sum of coordinate minima does not rule the similarity out."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p, q = points_of(batch.column("point_a")), points_of(batch.column("point_b"))
            sizes = batch.column("n_a").to_numpy() + batch.column("n_b").to_numpy()
            fit = pa.array(np.minimum(p, q).sum(1) * (100 + share) >= share * sizes)
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(fit) for c in "ab"], names=["a", "b"])

    return task


def _sets(width: int):
    """Sets of the wanted classes' representatives."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, "text"):
            sets = shingle_sets(part.column("text"), width)
            want = part.column("s").to_pylist()
            same = [(w, s.tobytes()) for w, s in zip(want, sets, strict=True) if len(s) and set_hash(s) == w]
            yield pa.RecordBatch.from_pydict({"s": pa.array([w for w, _ in same], pa.int64()), "shingles": pa.array([x for _, x in same], pa.binary())})

    return task


def _verify(share: int):
    """Of rows sorted by (a, salt, b), a's own set first (b null): the links."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, own = None, np.zeros(0, np.uint64)
        for batch in batches:
            out = []
            for a, salt, b, raw in zip(*(batch.column(c).to_pylist() for c in ("a", "salt", "b", "shingles")), strict=True):
                shingles = np.frombuffer(raw, np.uint64)
                if b is None:
                    at, own = (a, salt), shingles
                elif at == (a, salt):
                    if linked(own, shingles, share):
                        out.append((a, b))
                else:
                    raise RuntimeError("a set is missing")
            yield pa.RecordBatch.from_pydict({"a": pa.array([a for a, _ in out], pa.int64()), "b": pa.array([b for _, b in out], pa.int64())})

    return task


def verified(pairs: DataFrame, sets: DataFrame, share: int) -> DataFrame:
    """The pairs (a, b) whose sets reach the similarity. A set travels once for each pair it is b of."""
    sized = pairs.groupBy("a").agg(F.ceil(F.count("*") / BLOCK_MEMBERS).cast("int").alias("salts"))
    heads = sized.join(sets, sized["a"] == sets["s"]).select("a", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(None).cast("long").alias("b"), "shingles")
    members = pairs.join(sized, "a").join(sets, F.col("b") == sets["s"]).select("a", F.pmod(F.xxhash64("b"), F.col("salts").cast("long")).cast("int").alias("salt"), "b", "shingles")
    rows = heads.unionByName(members).repartition("a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first())
    return rows.mapInArrow(_verify(share), "a long, b long")


def link(docs: DataFrame, width: int = 5, share: int = 80, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(documents: id, n, s; classes: s, label) for classes that have links. ``share`` is the similarity in hundredths."""
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    id_type = docs.schema[id_col].dataType.simpleString()
    facts = materialize(texts.mapInArrow(tidy(_facts(width)), f"id {id_type}, n long, s long, point binary"), "jaccard-facts")
    posted = texts.select("text").mapInArrow(tidy(_postings(width, share)), "key long, s long")
    stars = posted.repartition("key").sortWithinPartitions("key", "s").mapInArrow(_stars, "least long, s long")
    buckets = materialize(stars.groupBy("least", "s").agg(F.count("*").alias("times")), "jaccard-buckets")
    wanted = buckets.select("s").distinct()
    classes = facts.where("s is not null").groupBy("s").agg(F.min("id").alias("id"), F.max("n").alias("n"), F.first("point").alias("point"))
    known = materialize(classes.join(wanted, "s"), "jaccard-classes")
    chosen = texts.join(known.select(F.col("id").alias("want"), "s"), F.col("id").eqNullSafe(F.col("want"))).select("s", "text")
    sets = materialize(chosen.mapInArrow(tidy(_sets(width)), "s long, shingles binary"), "jaccard-sets")
    ends = [known.select(F.col("s").alias(e), F.col("n").alias(f"n_{e}"), F.col("point").alias(f"point_{e}")) for e in "ab"]
    # Some rounds of one comparison a class: with the least member it shares most postings
    # with, among those of other components it has not met.
    labels = known.limit(0).select(F.col("s").alias("node"), F.col("s").alias("label"))
    met = known.limit(0).select(F.col("s").alias("least"), "s")
    for _ in range(ROUNDS):
        pairs = named(buckets.where("s <> least"), labels, "s", "least").where("label_s <> label_least").join(met, ["least", "s"], "left_anti")
        stars = materialize(pairs.groupBy(F.col("s").alias("b")).agg(F.max_by("least", F.struct("times", F.xxhash64("s", "least"))).alias("a")).select("a", "b"), "jaccard-stars")
        met = met.unionByName(stars.select(F.col("a").alias("least"), F.col("b").alias("s")))
        near = stars.join(ends[0], "a").join(ends[1], "b").mapInArrow(_bounded(share), "a long, b long")
        labels = joined(labels, materialize(verified(near, sets, share), "jaccard-links"))
    rows = blocks(named(buckets.select("least", "s"), labels, "s"), known, F.count("*") / BLOCK_MEMBERS)
    partnered = materialize(rows.mapInArrow(_open(share), "least long, s long").distinct(), "jaccard-open")
    rows = blocks(named(partnered, labels, "s"), known.join(sets, "s"), F.greatest(F.count("*") / BLOCK_MEMBERS, F.sum("n") * 8 / BLOCK_BYTES))
    links = rows.mapInArrow(_across(share), "a long, b long").distinct()
    return facts.drop("point"), joined(labels, materialize(links, "jaccard-links"))


def named(rows: DataFrame, labels: DataFrame, *cols: str) -> DataFrame:
    """The rows with the label of each column's class; a class without links is its own."""
    for c in cols:
        rows = rows.join(labels.select(F.col("node").alias(c), F.col("label").alias(f"label_{c}")), c, "left")
        rows = rows.withColumn(f"label_{c}", F.coalesce(f"label_{c}", c))
    return rows


def blocks(members: DataFrame, classes: DataFrame, parts: Column) -> DataFrame:
    """Members of buckets (least) with several labels, dealt out as pairs of blocks with what ``classes`` hold."""
    sized = members.join(classes.select("s", "n"), "s").groupBy("least")
    mixed = sized.agg(F.ceil(parts).cast("int").alias("parts"), F.min("label_s").alias("low"), F.max("label_s").alias("high")).where("low <> high")
    rows = (
        members.join(mixed.select("least", "parts"), "least")
        .withColumn("mine", F.pmod(F.xxhash64("s"), F.col("parts").cast("long")).cast("int"))
        .withColumn("with", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .select("least", F.least("mine", "with").alias("block"), F.greatest("mine", "with").alias("other"), "mine", "s", F.col("label_s").alias("label"))
        .join(classes.drop("id"), "s")
    )
    return rows.repartition("least", "block", "other").sortWithinPartitions("least", "block", "other")


def near_duplicates(docs: DataFrame, width: int = 5, share: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id) of every row; the component's least id."""
    facts, labels = link(docs, width, share, id_col, text_col)
    classes = facts.where("s is not null").groupBy("s").agg(F.min("id").alias("least"))
    named = classes.join(labels, F.col("s") == F.col("node"), "left").select("s", "least", F.coalesce("label", "s").alias("label"))
    heads = named.groupBy("label").agg(F.min("least").alias("component_id"))
    by_class = named.join(heads, "label").select(F.col("s").alias("class"), "component_id")
    out = facts.join(by_class, F.col("s") == F.col("class"), "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"))


def keep_one(docs: DataFrame, width: int = 5, share: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows without near duplicates: of each component the row with the least id stays.

    A component's rows are told apart by id and text, so a text that shares its id with a
    copy of another stays; rows without id count after all others. Of rows that repeat id
    and text one stays; rows without words stay, each of them.
    """
    names = docs.columns
    key_name, gone_name = fresh(names, "row_key", "gone_key")
    key = F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text"))
    # Texts without a word are linked with nothing; they stay as they are.
    worded = F.coalesce(F.col(text_col).rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    keyed = docs.where(worded).withColumn(key_name, key)
    groups = near_duplicates(keyed.select(key_name, text_col), width, share, key_name, text_col)
    gone = groups.where(F.col("component_id") != F.col(key_name)).select(F.col(key_name).alias(gone_name)).distinct()
    rest = keyed.join(gone, F.col(key_name) == F.col(gone_name), "left_anti")
    return rest.dropDuplicates([key_name, text_col]).select(*names).unionByName(docs.where(~worded))
