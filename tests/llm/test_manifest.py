"""Spelling variants, Merkle manifests and fingerprints against plain versions, over odd rows."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from broadsheet.llm import fingerprint, merkle, spelling
from tests.llm.test_text import some_texts

FULL = "doc_id long, text string, lang string, source string, n_chars long, word string, `a.b` string, pid long"


def full(spark, rows):
    """rows (id, text, source) with columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, None if t and len(t) % 3 == 0 else "en", s, len(t or ""), "x", "y", 1) for i, t, s in rows], FULL)


# 11 ---------------------------------------------------------------------------------------------------------------------


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def plain_variants(rows):
    n: dict = {}
    for i, t in rows:
        run = ""
        for c in (t or "") + " ":
            c = chr(ord(c) + 32) if "A" <= c <= "Z" else c
            if "a" <= c <= "z" or "À" <= c <= "ÿ":
                run += c
                continue
            if run:
                h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
                if h % 199 == 0:
                    k = h % len(run)
                    run = run[:k] + run[k + 1 :]
                n[run] = n.get(run, 0) + 1
            run = ""
    n = {w: k for w, k in n.items() if len(w) >= 6 and k >= 5}
    near = {w: [v for v in n if distance(w, v) == 1] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best and n[best] >= 5 * n[w] else None
    out = set()
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, n[w], len(near[w]), n.get(form[w])))
    return out


def words_of(rng, count):
    stems = ["".join(rng.choices("abcdé", k=rng.choice((6, 7, 8, 11)))) for _ in range(count)]
    out = []
    for s in stems:
        out += [s] * rng.choice((5, 30, 200))
        for _ in range(4):
            k = rng.randrange(len(s))
            out += [rng.choice((s[:k] + s[k + 1 :], s[:k] + "x" + s[k:], s[:k] + "z" + s[k + 1 :]))] * rng.choice((4, 5, 6, 30))
    # a half that many words share, at either end; chains of forms; long words
    for x in "abcdefghijklmnop":
        out += ["shared" + x + "tail"] * 5 + ["headway" + x] * 5 + [x + "endings"] * 6 + ["sharedtail"] * 9
    out += ["chains"] * 5 + ["chainsa"] * 25 + ["chainsab"] * 125 + ["chainsabc"] * 700
    out += ["y" * 3000] * 5 + ["y" * 2999 + "x"] * 40 + ["y" * 3001] * 6 + ["ÀÉÎÕÜß"] * 5 + ["ÀÉÎÕÜ"] * 9
    rng.shuffle(out)
    return out


def variant_rows():
    rng = random.Random(4)
    w = [x.upper() if rng.random() < 0.1 and x.isascii() else x for x in words_of(rng, 40)]
    rows = [(i, rng.choice((" ", "\n", ", ", "1")).join(w[k : k + 37])) for i, k in enumerate(range(0, len(w), 37))]
    return [*rows, (None, "chains chains"), (None, None), (3, ""), (3, rows[3][1]), (3, rows[3][1])]


@pytest.mark.parametrize("hot", (spelling.HOT, 3))
def test_spelling_variants(spark, hot):
    rows = variant_rows()
    got = spelling.variants(full(spark, [(i, t, "s") for i, t in rows]), hot)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert {tuple(r) for r in got.collect()} == plain_variants(rows)


def test_shards_split_heads(spark, monkeypatch):
    monkeypatch.setattr(spelling, "SHARD", 5)
    rows = variant_rows()
    assert {tuple(r) for r in spelling.variants(full(spark, [(i, t, "s") for i, t in rows])).collect()} == plain_variants(rows)


def test_near_is_distance_one():
    rng = random.Random(5)
    pairs = [("".join(rng.choices("ab", k=rng.randrange(6))), "".join(rng.choices("ab", k=rng.randrange(6)))) for _ in range(3000)]
    assert all(spelling.near(a, b) == (distance(a, b) == 1) for a, b in pairs)


# 12 ---------------------------------------------------------------------------------------------------------------------


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(r, text):
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    return digest(*[field(v) for v in (r["doc_id"], r["source"], r["lang"], r["n_chars"], text)])


def climb(nodes):
    """All levels over the nodes."""
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([digest(*out[-1][k : k + 16]) for k in range(0, len(out[-1]), 16)])
    return out


def siblings(levels, i):
    out = []
    for level in levels[:-1]:
        first = i // 16 * 16
        out.append((level[first:i], level[i + 1 : first + 16]))
        i //= 16
    return out


def plain_proofs(rows):
    lower = lambda t: t and "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)
    by: dict = {}
    for r in rows:
        by.setdefault(r["source"], []).append((plain_leaf(r, r["text"]), r))
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    for s in names:
        by[s].sort(key=lambda x: (x[1]["doc_id"] is not None, x[1]["doc_id"] or 0, x[0]))
    trees = [climb([x[0] for x in by[s]]) for s in names]
    top = climb([t[-1][0] for t in trees])
    out = []
    for k, s in enumerate(names):
        for i, (leaf, r) in enumerate(by[s]):
            bad = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0
            steps = siblings(trees[k], i) + siblings(top, k)
            node = plain_leaf(r, lower(r["text"])) if bad else leaf
            for left, right in steps:
                node = digest(*left, node, *right)
            root = top[-1][0]
            out.append((r["doc_id"], leaf, trees[k][-1][0], root, digest(*[h for a, b in steps for h in (*a, *b)]), node, node == root))
    return sorted(out, key=str)


def manifest_rows():
    texts = some_texts(100, 6)
    rows = [(i, texts[i % len(texts)], "hot" if i % 3 else f"s{i % 40}") for i in range(700)]
    return [*rows, (5, "Other Text", "hot"), (5, "Other Text", "hot"), (None, "No id", "hot"), (None, None, None), (9, "A", None), (11, "", ""), (12, "é" * 50, "é")]


def test_merkle_proofs(spark):
    d = full(spark, manifest_rows())
    made = merkle.build(d, tamper=merkle.every_fifth(F.col("doc_id")))
    got = made.proofs()
    assert sorted((tuple(r[c] for c in ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")) for r in got.collect()), key=str) == plain_proofs(d.collect())
    for r in got.where("verified").limit(40).collect():
        assert merkle.fold(r["leaf"], [(s["left"], s["right"]) for s in r["proof"]]) == r["root"]
    want = {(r["source"], r["n"]) for r in d.groupBy("source").agg(F.count("*").alias("n")).collect()}
    roots = made.roots().collect()
    assert {(r["source"], r["n_leaves"]) for r in roots} == want and len({r["root"] for r in roots}) == 1


@pytest.mark.parametrize("rows", ([(4, "One", "s")], [(4, "One", None), (4, "One", None)], [(i, "x", f"s{i}") for i in range(300)]))
def test_merkle_small_trees(spark, rows):
    d = full(spark, rows)
    got = merkle.build(d, tamper=merkle.every_fifth(F.col("doc_id"))).proofs(siblings=False).drop("proof")
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain_proofs(d.collect())


def test_fragments_merge_in_any_order():
    """The forest is a commutative monoid: any grouping of fragments ends in the same root."""
    rng = random.Random(7)
    leaves = [digest(str(i)) for i in range(700)]
    want = climb(leaves)[-1][0]
    for _ in range(5):
        cuts = sorted(rng.sample(range(1, 700), 12))
        parts = [[(0, 0, i, leaves[i], 700) for i in range(a, b)] for a, b in zip([0, *cuts], [*cuts, 700])]
        rng.shuffle(parts)
        while len(parts) > 1:
            a = parts.pop(rng.randrange(len(parts)))
            b = parts.pop(rng.randrange(len(parts)))
            parts.append(merkle.merge(a + b, 1)[0])
        assert not parts[0] or {x[3] for x in parts[0]} == {want}


# 13 ---------------------------------------------------------------------------------------------------------------------


def test_fingerprints(spark):
    rng = random.Random(8)
    words = [f"w{i}é" for i in range(3000)]
    texts = [*some_texts(60, 9), *[" ".join(rng.choices(words, k=n)) for n in (300, 300, 2000, 9000)], "a" * 40_000, "𝒳" * 31]
    rows = [(i, t, "s") for i, t in enumerate(texts)]
    d = full(spark, rows)
    got = {r["doc_id"]: r for r in fingerprint.edited(d).collect()}
    assert len(got) == len(rows)
    for k, (i, t, _) in enumerate(rows):
        t, after = t or "", rows[(k + 1) % len(rows)][1] or ""
        h = len(t) // 2
        edited = t[: len(t) - h] + after[:h]
        r = got[i]
        assert (r["n_chars"], r["edited"], r["edited_sha256"]) == (len(t), edited, hashlib.sha256(edited.encode()).hexdigest())
        assert r["fingerprint"] == fingerprint.fingerprint(t) and r["edited_fingerprint"] == fingerprint.fingerprint(edited)
        assert r["near_edited"] == fingerprint.likeness(r["fingerprint"], r["edited_fingerprint"])
        assert r["near_next"] == fingerprint.likeness(r["fingerprint"], fingerprint.fingerprint(after))
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
        if "w" in t and "\n" not in t and len(t) > 1000:
            assert r["near_edited"] > 0.3


def test_fingerprint_order_of_rows(spark):
    """Null ids come first, rows of one id side by side, a lone document follows itself."""
    lone = fingerprint.edited(full(spark, [(3, "abcdef", "s")])).first()
    assert (lone["edited"], lone["near_next"]) == ("abcabc", 1.0)
    rows = [(2, "BBBB", "s"), (None, "nnnn", "s"), (2, "BBBB", "s"), (7, None, "s"), (9, "", "s")]
    got = fingerprint.edited(full(spark, rows)).collect()
    assert sorted((str(r["doc_id"]), r["edited"], r["n_chars"]) for r in got) == [("2", "BB", 4), ("2", "BBBB", 4), ("7", "", 0), ("9", "", 0), ("None", "nnBB", 4)]


def test_boundaries_are_local():
    """A change in the middle leaves what is before and after it; unrelated texts have nothing in common."""
    rng = random.Random(10)
    a = "".join(rng.choices("abcdefghij klmnop", k=20_000))
    b = "".join(rng.choices("abcdefghij klmnop", k=20_000))
    mark = fingerprint.fingerprint
    assert fingerprint.likeness(mark(a), mark(a[:9000] + "inserted" + a[9000:])) > 0.9
    assert fingerprint.likeness(mark(a), mark(b)) == 0.0
    assert fingerprint.likeness(mark(a), mark(b)) == fingerprint.likeness(mark(b), mark(a))


def subsequence(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
        row = new
    return row[-1]


def test_common_subsequence():
    rng = random.Random(11)
    for _ in range(300):
        a, b = ("".join(rng.choices("abc", k=rng.randrange(12))) for _ in range(2))
        assert fingerprint.common_subsequence(a, b) == subsequence(a, b)


def test_fingerprint_columns(spark):
    d = spark.createDataFrame([("aaaa bbbb",), (None,), ("aaaa bbbb",)], "text string").select(fingerprint.fingerprints("text").alias("f"))
    a, b, c = (r["f"] for r in d.collect())
    assert a == c and b == "3::"
    assert d.select(fingerprint.fingerprint_likeness("f", F.lit(a)).alias("x")).collect()[0]["x"] == 1.0
