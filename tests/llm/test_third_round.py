"""SetSketch near duplicates, conversation repair and token alignment against brute force."""

import collections
import hashlib
import heapq
import itertools
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest

from leafmill.llm import alignment, order_minhash, repair, setsketch

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = "doc_id long, text string, id string, s long, n long, label string, g int, block int"
REST = ("extra", 1, 2, "label", 3, 4)


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def shingles(text, width):
    words = WORD.findall(lower(text or ""))
    if len(words) < width:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)}


def near_texts(seed=1):
    """Groups of copies with growing numbers of edits, and odd texts."""
    rng = random.Random(seed)
    say = lambda k: ["".join(rng.choices("abcdefgh", k=5)) for _ in range(k)]
    texts = []
    for size in (1, 2, 5, 40):
        base = say(rng.choice([60, 200]))
        for i in range(size):
            words = list(base)
            for _ in range(rng.randrange(0, 1 + i % 7)):
                words[rng.randrange(len(words))] = "edit" + str(rng.random())
            texts.append(" ".join(words))
    texts += [texts[3], texts[3].upper(), None, "", " \t\n", "one", "One", "one two", "　", "　", "x " * 5000, "é ü " * 9]
    return texts


def components_of(rows, width, share):
    sets = [shingles(t, width) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        both = len(sets[i] & sets[j])
        if sets[i] and sets[j] and 100 * both >= share * (len(sets[i]) + len(sets[j]) - both):
            parent[root(i)] = root(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        r = root(i)
        least[r] = min((x for x in (least.get(r), doc) if x is not None), default=None)
    return sorted(((doc, len(s), least[root(i)], doc is not None and doc == least[root(i)]) for i, ((doc, _), s) in enumerate(zip(rows, sets))), key=repr)


@pytest.mark.parametrize(("width", "share"), [(5, 85), (5, 80), (2, 70)])
def test_setsketch_equals_brute_force(spark, width, share):
    texts = near_texts()
    rows = [(i if i % 9 else None, t) for i, t in enumerate(texts)] + [(3, texts[3]), (None, texts[1])]
    docs = spark.createDataFrame([(*r, *REST) for r in rows], ODD).repartition(3)
    got = setsketch.near_duplicates(docs, width, share).collect()
    assert sorted((tuple(r) for r in got), key=repr) == components_of(rows, width, share)
    assert setsketch.near_duplicates(docs.limit(0), width, share).count() == 0


def test_setsketch_splits_large_buckets(spark, monkeypatch):
    monkeypatch.setattr(setsketch, "BLOCK_MEMBERS", 7)
    rows = list(enumerate(near_texts(4)))
    docs = spark.createDataFrame([(*r, *REST) for r in rows], ODD)
    assert sorted((tuple(r) for r in setsketch.near_duplicates(docs, 5, 85).collect()), key=repr) == components_of(rows, 5, 85)


def test_sketches_merge_and_estimate():
    rng = np.random.default_rng(2)
    both, one, two = (rng.integers(0, 2**64, n, np.uint64) for n in (6000, 1000, 1500))
    a, b = np.concatenate([both, one]), np.concatenate([both, two])
    x, y = setsketch.registers(a), setsketch.registers(b)
    assert (setsketch.merge(x, y) == setsketch.registers(np.concatenate([a, b]))).all()
    assert abs(setsketch.estimate(x, y, len(a), len(b)) - 6000 / 8500) < 0.12
    errors = []
    for seed in range(60):
        v = np.random.default_rng(seed).integers(0, 2**64, 400, np.uint64)
        errors.append(setsketch.estimate(setsketch.registers(v[:360]), setsketch.registers(v[40:]), 360, 360) - 0.8)
    assert abs(np.mean(errors)) < 0.015 and np.std(errors) < 0.04
    hits = [(setsketch.registers(v[:380]).reshape(-1, 6) == setsketch.registers(v[20:]).reshape(-1, 6)).all(1).any() for v in np.random.default_rng(9).integers(0, 2**64, (80, 400), np.uint64)]
    assert all(hits)


# ---- conversations -----------------------------------------------------------------
GRAMMAR = re.compile(r"(s?(ua)+)?")


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        hit = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if hit == 0:
            continue
        if hit == 1:
            text = ""
        if hit == 2:
            text = re.sub("[.!?]", "", text)
        if hit == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (2 if hit == 3 else 1)
    return out


def cheapest(rows, faults):
    """Least (cost, audit) by search over all edits, and the rows it leaves."""
    queue = [(0, "", 0, "", ())]  # cost, audit, row, initials, left
    seen = set()
    while queue:
        cost, audit, i, initials, left = heapq.heappop(queue)
        state = ("" if not initials else "s" if initials == "s" else initials[-1], i)
        if state in seen:
            continue
        if i == len(rows) and GRAMMAR.fullmatch(initials):
            return cost, audit, left
        seen.add(state)
        if not re.fullmatch(r"s?(ua)*u?", initials):
            continue
        if i < len(rows):
            role, text = rows[i]
            heapq.heappush(queue, (cost + 2, audit + "D", i + 1, initials, left))
            if faults[i] not in ("blank", "duplicate"):
                late = 5 if faults[i] == "truncated" else 0
                for new, edit, price in ((role, "K", 0), ("user", "R", 1), ("assistant", "R", 1)):
                    if re.fullmatch(r"s?(ua)*u?", initials + new[:1]) and new:
                        heapq.heappush(queue, (cost + price + late, audit + edit, i + 1, initials + new[0], (*left, (new, text))))
        for new in ("user", "assistant"):
            if re.fullmatch(r"s?(ua)*u?", initials + new[0]) and len(audit) < len(rows) + 4:
                heapq.heappush(queue, (cost + 5, audit + "I", i, initials + new[0], (*left, (new, ""))))
    raise AssertionError


def repaired(rows):
    groups = {conv: [] for conv, *_ in rows}
    for conv, turn, role, text in damaged(rows):
        groups[conv].append((turn, role, text))
    out = []
    for conv, mine in groups.items():
        mine.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest()))
        seen, faults = set(), []
        for _, role, text in mine:
            body = "".join(WORD.findall(text))
            faults.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
            seen.add((role, text))
        turns = {t for t, *_ in mine if t is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(mine))
        cost, audit, left = cheapest([r[1:] for r in mine], faults)
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in left).encode()).hexdigest()
        n = collections.Counter(faults)
        out.append((conv, gaps, n["blank"], n["duplicate"], n["truncated"], illegal, cost, audit, digest))
    return sorted(out, key=repr)


CONVERSATION = "conv_id long, turn long, role string, text string, kind int, audit string, digest string"


def talks(seed=5, n=220):
    rng = random.Random(seed)
    rows = []
    for conv in range(n):
        for turn in range(rng.choice([0, 1, 2, 3, 5, 9])):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None])
            rows.append((conv, turn + rng.choice([0, 0, 0, 1, 2]) if rng.random() > 0.03 else None, role, rng.choice(["Yes.", "no", " \t", "", None, f"w{rng.random()}!", "end. \n", "Yes."])))
    rows += [(None, 1, "user", "hello."), (None, 1, "user", "hello."), (None, 2, "assistant", "bye."), (None, None, "x", "y")]
    rows += [(1000, t, "user" if t % 2 == 0 else "assistant", f"line {t}." if t % 17 else "cut") for t in range(300)]
    return rows


def test_repair_equals_search(spark):
    rows = talks()
    table = spark.createDataFrame([(*r, 7, "a", "d") for r in rows], CONVERSATION).repartition(3)
    got = sorted((tuple(r) for r in repair.repair(table).select("conv_id", *repair.FIGURES, "audit", "repaired_sha256").collect()), key=repr)
    assert got == repaired(rows)
    assert repair.repair(table.limit(0)).count() == 0


def test_signatures_of_every_kind():
    """Every signature of up to four letters, in the sorted order of a task."""
    letters = {"s": ("system", "a."), "u": ("user", "a."), "a": ("assistant", "a."), "x": ("tool", "a."), "d": ("user", ""), "S": ("system", "a"), "U": ("user", "a"), "A": ("assistant", "a"), "X": ("tool", "a")}
    signatures = ["".join(p) for n in range(4) for p in itertools.product(letters, repeat=n)] + ["uauuaaau" * 3, "sSsdxua"]
    automaton = repair.Automaton()
    for s in sorted(signatures, key=lambda s: s[::-1]):
        faults = ["blank" if c == "d" else "truncated" if c.isupper() else "" for c in s]
        cost, audit, _ = cheapest([letters[c] for c in s], faults)
        assert automaton.solve(s) == (cost, audit), s
    assert len(automaton.known) < 400


def test_long_conversation_is_linear():
    signature = "suauUxd" * 20_000
    cost, audit = repair.Automaton().solve(signature)
    assert cost > 0 and len(audit) >= len(signature)


# ---- alignment ----------------------------------------------------------------------
BYTES, PIECES = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model"))


@pytest.fixture(scope="module")
def coders():
    with open(BYTES, encoding="utf-8") as f, open(PIECES, "rb") as g:
        return alignment.Coders(f.read(), g.read())


def aligned(coders, texts):
    """Contract columns by plain loops."""
    rows, held = [], collections.Counter()
    for text in texts:
        a, b, groups = [], [], []
        if text:
            want = (" " + text).encode()
            a = coders.byte_level.encode(" " + text, add_special_tokens=False).ids
            b = coders.pieces.encode(text)
            if b"".join(coders.a_bytes[i] for i in a) != want or b"".join(coders.b_bytes[i] for i in b) != want:
                a, b = [], []
        ends = [list(itertools.accumulate(len(t[i]) for i in ids)) for t, ids in ((coders.a_bytes, a), (coders.b_bytes, b))]
        common = sorted(set(ends[0]) & set(ends[1]))
        for lo, hi in zip([0, *common], common):
            groups.append(tuple([i for i, e in zip(ids, end) if lo < e <= hi] for ids, end in zip((a, b), ends)))
        links = [(x, y) for p, q in groups for x in p for y in q]
        held.update(set(links))
        rows.append((a, b, groups, links))
    top = {}
    for (x, _), n in held.items():
        top[x] = max(top.get(x, 0), n)
    out = []
    for i, (a, b, groups, links) in enumerate(rows):
        said = ";".join(f"{','.join(map(str, p))}|{','.join(map(str, q))}" for p, q in groups)
        digest = hashlib.sha256(said.encode()).hexdigest() if a else ""
        out.append((i, len(a), len(b), len(groups), len(links), sum(held[p] == top[p[0]] for p in links), sum(held[p] for p in links), digest))
    return out


def speech(n=50):
    rng = random.Random(8)
    words = ["the", "house", "unbelievable", "naïve", "Straße", "東京", "日本語", "42", "3.14", "👍🏽", "don't", "<|endoftext|>", "<s>", "</s>", "a\nb", "  ", "\t", "ﬁ", "x" * 40]
    texts = [rng.choice([" ", ""]).join(rng.choices(words, k=rng.randint(1, 60))) for _ in range(n)]
    return [*texts, None, "", " ", "\n", "▁", "\x00", "a" * 3000, "🙂" * 400, "the house " * 2000, texts[0], texts[0]]


def test_alignment_equals_loops(spark, coders):
    texts = speech()
    docs = spark.createDataFrame([(i, t, *REST) for i, t in enumerate(texts)], ODD).repartition(3)
    got, pairs = alignment.align(docs, BYTES, PIECES)
    columns = ["doc_id", *alignment.FACTS, "n_best", "count_sum", "groups_sha256"]
    assert sorted(tuple(r) for r in got.select(columns).collect()) == aligned(coders, texts)
    assert pairs.where("best").select("a_id").distinct().count() == pairs.select("a_id").distinct().count()
    assert alignment.align(docs.limit(0), BYTES, PIECES)[0].count() == 0


def test_ranks_are_the_same_tokenizer(coders):
    """Every character that goes by ranks, in several surroundings, and whole texts."""
    texts = [f(chr(i)) for i in range(0x370) for f in (lambda c: f" a{c}b", lambda c: f" 1{c}{c} {c}2", lambda c: f" {c}'{c}s  {c}\n {c}!{c}", lambda c: c * 5)]
    texts += [" " + t for t in speech() if t and alignment.LATER.search(t) is None]
    assert coders.ranked is not None and not any(alignment.LATER.search(t) for t in texts)
    assert coders.byte_ids(texts) == [e.ids for e in coders.byte_level.encode_batch(texts, add_special_tokens=False)]


def test_wide_groups_count_alike(coders, monkeypatch):
    coded = [c for c in coders.encode(["日本語" * 50, "naïve 👍🏽" * 20, "a b c"]) if c]
    one = alignment.Aligned(coders, coded)
    plain = one.links(np.arange(len(coded)))
    monkeypatch.setattr(alignment, "WIDE_GROUP", 0)
    for x, y in zip(plain, one.links(np.arange(len(coded))), strict=True):
        assert (x == y).all()


def test_bitmaps_round_trip():
    rng = np.random.default_rng(3)
    for top, n in ((1, 1), (300, 2), (32768, 3), (32768, 900), (32768, 30000)):
        docs = np.sort(rng.choice(top, n, replace=False))
        assert (alignment.unpacked(*alignment.packed(docs, top)) == docs).all()
        times = rng.integers(1, 9, n)
        assert (alignment.times_of(alignment.planes_of(times), n) == times).all()
    assert alignment.planes_of(np.ones(5, np.int64)) is None


# ---- order MinHash: repeated rows -------------------------------------------------
def test_edit_report_returns_every_row(spark):
    """Digests of the edited texts by plain Python, repeated ids and rows included."""
    texts = [(5, "five words are in here now"), (1, "one"), (1, "one"), (1, "one"), (3, None), (2, ""), (9, "the last of all these documents"), (None, "no id at all here"), (7, "é" * 41)]
    docs = spark.createDataFrame([(*r, *REST) for r in texts], ODD).repartition(3)
    got = order_minhash.edit_report(docs).collect()
    rows = sorted(((d, t or "") for d, t in texts), key=lambda r: (r[0] is not None, r[0] or 0))
    want = []
    for i, (d, t) in enumerate(rows):
        following = rows[(i + 1) % len(rows)][1]
        q = len(t) // 4
        edited = t[: len(t) - q] + following[:q]
        want.append((d, len(t), hashlib.sha256(edited.encode()).hexdigest()))
    assert sorted(((r.doc_id, r.n_chars, r.edited_sha256) for r in got), key=repr) == sorted(want, key=repr)
    ones = [r for r in got if r.doc_id == 1]
    assert len(ones) == 3 and len({r.fingerprint for r in ones}) == 1 and sorted(r.near_next for r in ones)[-2:] == [1.0, 1.0]
    prints = {(r.doc_id, r.fingerprint) for r in order_minhash.order_minhash(docs).collect()}
    assert prints == {(r.doc_id, r.fingerprint) for r in got} and order_minhash.order_minhash(docs).count() == len(texts)
