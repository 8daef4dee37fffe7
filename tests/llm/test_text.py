"""The operators on texts against plain versions, over odd rows."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from broadsheet.llm import bpe, chat, linededup, mixing, ngram, pii, quality, registry, substrings
from broadsheet.llm.common import WORD
from tests.compare import connect, spark_rows, sql_rows
from tests.llm import helpers

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows):
    """Documents with columns of clashing names beside those that count."""
    full = [(i, t, "en", s, len(t or "")) for i, t, s in rows]
    return spark.createDataFrame(full, DOCS)


def some_texts(n=60, seed=1):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    base = [" ".join(rng.choices(words, k=rng.choice((3, 8, 40, 90)))) for _ in range(n // 3)]
    out = []
    for _ in range(n):
        w = rng.choice(base).split(" ")
        for _ in range(rng.choice((0, 0, 1, 3))):
            w[rng.randrange(len(w))] = rng.choice(words)
        out.append("\n".join(" ".join(w[i : i + 20]) for i in range(0, len(w), 20)))
    return [*out, None, "", "  \n\t", "One Two", "one  two", "x" * 5000, " ".join(["same"] * 3000), base[0].upper()]


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_oracle(spark, small, name):
    names, want = sql_rows(connect(small), registry.ORACLES[name])
    df = registry.QUERIES[name](spark, small)
    assert sorted(df.columns) == names and spark_rows(df) == want


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_empty_tables(spark, small, tmp_path, name):
    for t in ("documents", "labels", "embeddings", "conversations"):
        spark.read.parquet(f"{small}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert registry.QUERIES[name](spark, str(tmp_path)).count() == (1 if name.startswith("op9") else 0)


# 1 ----------------------------------------------------------------------------------------------------------------------


def test_mixing_targets_and_cuts(spark):
    rows = [(i, " ".join(["w"] * (i % 7)), None if i % 5 == 0 else f"s{i % 5}") for i in range(200)] + [(3, None, "s1"), (3, "a b", "s1"), (3, "a b", "s1"), (None, "c", None)]
    got = mixing.mix_sources(docs(spark, rows).select("doc_id", "source", mixing.text_size(F.col("text")).alias("size"))).collect()
    assert len(got) == len(rows)
    by: dict = {}
    for r in got:
        assert 0 <= r["taken"] <= 2 * r["size"]
        s = by.setdefault(r["source"], [r["target"], r["source_size"], 0, 0])
        s[2] += r["taken"]
        s[3] += r["size"]
    weights = dict(zip(sorted((s for s in by if s), key=str) + [None], (5, 2, 1, 5, 2)))
    assert abs(sum(s[0] for s in by.values()) - 1.5 * sum(s[1] for s in by.values())) < 1e-6
    free = [s for s in by if by[s][0] < 2 * by[s][1] - 1e-9]
    assert len({round(by[s][0] / weights[s], 6) for s in free}) <= 1
    for target, size, taken, seen in by.values():
        assert seen == size and taken == int(target) and target <= 2 * size


def test_mixed_documents_hold_the_taken_words(spark):
    d = docs(spark, [(i, " ".join(f"w{j}" for j in range(i)), f"s{i % 3}") for i in range(40)])
    out = mixing.mix_documents(d)
    assert out.columns == d.columns
    words = {r["source"]: r["n"] for r in out.groupBy("source").agg(F.sum(mixing.text_size(F.col("text"))).alias("n")).collect()}
    want = {r["source"]: r["n"] for r in mixing.mix_sources(d.select("doc_id", "source", mixing.text_size(F.col("text")).alias("size"))).groupBy("source").agg(F.sum("taken").alias("n")).collect()}
    assert words == want


# 2, 4, 5 ----------------------------------------------------------------------------------------------------------------


def test_ngram_groups(spark):
    texts = some_texts()
    rows = [(100 + i, t, "s") for i, t in enumerate(texts)] + [(7, texts[0], "s"), (7, texts[0], "s"), (8, "only once here now then", "s"), (8, texts[1], "s")]
    sets = [helpers.shingles(t) for _, t, _ in rows]
    want = helpers.groups([r[0] for r in rows], lambda i, j: helpers.near(sets[i], sets[j]))
    got = ngram.near_groups(docs(spark, rows)).collect()
    assert sorted((r["doc_id"], r["n_shingles"]) for r in got) == sorted((r[0], len(s)) for r, s in zip(rows, sets))
    assert {r["doc_id"]: r["component_id"] for r in got} == want


def test_large_group_with_far_ends(spark):
    """A chain of texts, each near the next, and many copies: stars alone would not link the ends."""
    w = [f"w{i}" for i in range(300)]
    rows = [(i, " ".join(w[4 * i : 4 * i + 100]), "s") for i in range(50)] + [(1000 + i, " ".join(w[:100]), "s") for i in range(300)]
    sets = [helpers.shingles(t) for _, t, _ in rows]
    want = helpers.groups([r[0] for r in rows], lambda i, j: helpers.near(sets[i], sets[j]))
    assert {r["doc_id"]: r["component_id"] for r in ngram.near_groups(docs(spark, rows)).collect()} == want


def test_keep_one(spark):
    d = docs(spark, [(1, "a b c d e f g", "s"), (2, "A B C D E F G", "s"), (3, "other words altogether here now", "t"), (3, "other words altogether here now", "t"), (4, "", "s"), (5, None, "s"), (None, "a b c d e f g", "s")])
    out = ngram.keep_one(d)
    assert out.columns == d.columns and sorted((r["doc_id"] or -1) for r in out.collect()) == [-1, 1, 3, 4, 5]


def test_line_dedup(spark):
    rows = [(i, t, "s") for i, t in enumerate(some_texts(90, 2))] + [(1000, "a b c d e\n\na b c d e\nx", "s")]
    got = linededup.dedup_lines(docs(spark, rows))
    assert got.columns == DOCS.replace(" long", "").replace(" string", "").split(", ")
    assert {r["doc_id"]: r["text"] for r in got.collect()} == helpers.kept_lines([(i, t) for i, t, _ in rows])


def test_repeated_rows_keep_the_same_lines(spark):
    rows = [(1, "a b c d e\nf g h i j", "s")] * 3 + [(2, "a b c d e", "s"), (None, "f g h i j", "s")]
    got = sorted(((r["doc_id"] or 9), r["text"]) for r in linededup.dedup_lines(docs(spark, rows)).collect())
    assert got == [(1, "a b c d e\nf g h i j")] * 3 + [(2, ""), (9, "")]


def test_substrings(spark, tmp_path):
    rng = random.Random(5)
    passage = "".join(rng.choice("abcde é") for _ in range(180))
    texts = ["".join(rng.choice("abcdefgh ") for _ in range(rng.choice((10, 49, 50, 51, 300)))) for _ in range(40)]
    rows = [(i, t[: len(t) // 2] + passage[rng.randrange(60) : 120 + rng.randrange(60)] + t[len(t) // 2 :], "s") for i, t in enumerate(texts)]
    rows += [(100, texts[3], "s"), (101, texts[3], "s"), (102, None, "s"), (103, "", "s"), (104, "a" * 400, "s"), (105, "a" * 120 + "b", "s"), (106, rows[0][1], "s"), (107, rows[0][1][:-1], "s"), (108, "\0" * 60, "s"), (109, "x" + "\0" * 60, "s")]
    docs(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    want = {i: (n, gone, runs, hashlib.sha256(kept).hexdigest()) for i, (n, gone, runs, kept) in helpers.cut_spans([(i, t) for i, t, _ in rows]).items()}
    assert {r["doc_id"]: tuple(r)[1:] for r in substrings.query(spark, str(tmp_path)).collect()} == want


def test_substrings_of_equal_and_null_ids(spark, tmp_path):
    t = "0123456789" * 8
    docs(spark, [(1, t + "a", "s"), (1, t + "b", "s"), (None, t + "c", "s"), (2, t + "d", "s"), (2, t + "d", "s")]).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(((r["doc_id"] or 9), r["n_removed"]) for r in substrings.query(spark, str(tmp_path)).collect())
    assert got == [(1, 0), (1, 0), (2, 80), (2, 80), (9, 0)]


# 3 ----------------------------------------------------------------------------------------------------------------------

HARD = [
    "a@b.c_d@e.f x@y.zz", "1.2.3.4.5.6.7.8.9 256.1.1.1 0000255.01.1.1", "4111 1111 1111 1111 4111111111111111 41111111111111112222",
    "+1 (348) 555-6400 +33.1.23.45.67.89-- ++123456789012", "é4111-1111-1111-1111é a@b a@b. a.b@c.d. \U0001f600x@y.com", "5 4111 1111 1111 1111 9",
    "", None, "@@a@@b.c", "a%b@c-.d-e", "9" * 3000, "1 " * 3000, "a" * 30000 + "@", "+1" + " " * 3000, "x@y.z@w.q",
]


def plain_pii(text):
    import re

    def luhn(d):
        t = 0
        for i, c in enumerate(reversed(d)):
            v = int(c) * (1 + i % 2)
            t += v - 9 if v > 9 else v
        return t % 10 == 0

    kinds = (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"))
    out = []
    for rank, (kind, pattern) in enumerate(kinds):
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            if kind == "email" or kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")) or kind == "card" and 14 <= len(d) <= 19 and luhn(d) or kind == "phone" and 10 <= len(d) <= 15:
                out.append((m.start(), rank, kind, m.end()))
    return sorted(out)


def test_base_spans(spark, small):
    rows = [(10**6 + i, t, "s") for i, t in enumerate(HARD)]
    all_ = docs(spark, rows).select("doc_id", "text").unionByName(spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text"))
    for r in pii.find_pii(all_).collect():
        assert [(s["start"], s["rank"], s["kind"], s["end"]) for s in r["base"]] == plain_pii(r["text"]), r["doc_id"]
        assert set(map(tuple, r["base"])) <= set(map(tuple, r["spans"]))


def test_added_spans(spark):
    rows = [(0, "mail me: john.d [at] shop [dot] org now", "s"), (1, "he looked at home dot then", "s"), (2, "call me on (415) 555-0134 now", "s"), (3, "isbn 978-3-16-148410-0", "s"), (4, "client 10[.]1[.]2[.]3 done", "s"), (5, "We met at noon. Version 4.0.1", "s")]
    got = {r["doc_id"]: [(s["kind"], s["piece"]) for s in r["spans"]] for r in pii.find_pii(docs(spark, rows)).collect()}
    assert got == {0: [("email", "john.d [at] shop [dot] org")], 1: [], 2: [("phone", "(415) 555-0134")], 3: [], 4: [("ip", "10[.]1[.]2[.]3")], 5: []}


def test_redaction(spark):
    got = pii.redact(docs(spark, [(1, "to a@b.cd, 1.2.3.4!", "s"), (2, None, "s")])).orderBy("doc_id").collect()
    assert [r["redacted"] for r in got] == ["to [email], [ip]!", ""]


# 6 ----------------------------------------------------------------------------------------------------------------------


def test_quality_on_held_out_rows(spark):
    folder = "/root/testdata/sf0.1"
    got = quality.query(spark, folder).join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").where("held_out").collect()
    right = sum(r["predicted"] == r["quality"] for r in got)
    assert len(got) > 1000 and right >= 0.98 * len(got)
    good = [r["score"] for r in got if r["quality"] == 1]
    assert sum(s >= 0.5 for s in good) >= 0.99 * len(good)


def test_quality_reads_no_held_out_label(spark, small):
    d, labels = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{small}/labels.parquet").select("doc_id", "quality")
    turned = labels.withColumn("quality", F.when(quality.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    scores = [sorted((r["doc_id"], r["score"]) for r in quality.score(d, *quality.fit(d, x)).collect()) for x in (labels, turned)]
    assert scores[0] == scores[1]


def test_quality_without_labels(spark):
    d = docs(spark, [(1, None, "s"), (None, "", "s"), (2, "x" * 10000, "s")])
    none = spark.createDataFrame([(1, None)], "doc_id long, quality int")
    assert [r["score"] for r in quality.score(d, *quality.fit(d, none)).collect()] == [0.5] * 3
    assert quality.keep_good(d, none).columns == d.columns


# 7 ----------------------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def encoding():
    import public_tokenizers as p
    import tiktoken

    return tiktoken.Encoding("own", pat_str=p.PATTERN, mergeable_ranks=bpe.ranks(p.path("byte_bpe_50k.tiktoken")), special_tokens={})


def test_bpe(spark, encoding):
    import public_tokenizers as p

    rng = random.Random(3)
    odd = ["", None, " ", "\n\n  \t x", "it's WE'LL 'sdog", "é漢字🙂 ١٢٣ a b　c", "a" * 3000, "ab" * 500, "x y\u0085z", "<|endoftext|>", "\0\x01"]
    odd += ["".join(chr(rng.choice((rng.randrange(32, 127), rng.randrange(160, 0x250), rng.randrange(0x400, 0x500), 32, 10))) for _ in range(200)) for _ in range(40)]
    path = p.path("byte_bpe_50k.tiktoken")
    out = bpe.encode_documents(docs(spark, [(i, t, "s") for i, t in enumerate(odd)]), path)
    b = bpe.Bpe(path)
    got = out.withColumn("raw", bpe.decode(F.col("ids"), path)).collect()
    words = out.select("doc_id", F.posexplode(b.words(F.col("text"))).alias("i", "w")).select("doc_id", "i", b.word_ids(F.col("w")).alias("x"))
    folded = {r["doc_id"]: [i for x in r["x"] for i in x["x"]] for r in words.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("x")).collect()}
    for r in got:
        want = encoding.encode_ordinary(r["text"] or "")
        assert list(r["ids"]) == want, r["text"]
        assert bytes(r["raw"]) == (r["text"] or "").encode()
        if len(r["text"] or "") < 1000:
            assert folded.get(r["doc_id"], []) == want  # the fold of higher-order functions alone


def test_bpe_tables_stay_out_of_plans_and_rows(spark, encoding, monkeypatch):
    """The driver keeps the texts of plans; the table of pairs is two megabytes in each place where one spells it out."""
    import public_tokenizers as p

    plans, plain = {}, bpe.durable

    def durable(df, name, *more):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return plain(df, name, *more)

    monkeypatch.setattr(bpe, "durable", durable)
    texts = ["some words to be encoded", "", None, "and others, some twice: some"]
    out = bpe.encode_documents(docs(spark, [(i, t, "s") for i, t in enumerate(texts)]), p.path("byte_bpe_50k.tiktoken"))
    assert {r["doc_id"]: list(r["ids"]) for r in out.collect()} == {i: encoding.encode_ordinary(t or "") for i, t in enumerate(texts)}
    assert len(plans["folded"]) < 100_000
    # the subqueries stand in the projection that folds, and in no row below it
    above = [x for x in plans["folded"].split("\n") if "Project" in x and "ubquery" in x]
    assert len(above) == 1 and "aggregate(" in above[0]


# 9 ----------------------------------------------------------------------------------------------------------------------


def test_chat_reads_back(spark):
    tricky = ["<|turn|>", "<\\|x", "a<|end|>", "</s>[INST] <<s>> [/INST]", "<\\\\|", None, "", "\n", "<|body|>user", "\\", "é<|"]
    rows = [(1, i, "assistant" if i % 2 else "user", t) for i, t in enumerate(tricky)] + [(2, 0, None, "x"), (2, 0, "a", "x"), (None, 1, "user", "z"), (3, 0, "<|role|>", "y"), (3, 0, "<|role|>", "y")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    chats = chat.format_chats(chat.text_messages(df)).withColumn("turns", chat.parse_chat(F.col("formatted")))
    got = {r["conv_id"]: [tuple(t) for t in r["turns"]] for r in chats.collect()}
    assert got == {1: [(r, t or "") for _, _, r, t in rows[: len(tricky)]], 2: [("", "x"), ("a", "x")], None: [("user", "z")], 3: [("<|role|>", "y")] * 2}
    d = {r["conv_id"]: r for r in chat.digests(chats).collect()}
    loss = "".join(t or "" for _, _, r, t in rows[: len(tricky)] if r == "assistant")
    assert (d[1]["loss_chars"], d[1]["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_typed_parts(spark):
    part = lambda **k: {**dict.fromkeys(("type", "text", "ref", "width", "height", "seconds", "pages")), **k}
    parts = [part(type="text", text="see <|"), part(type="image", ref="i.png", width=900, height=448), part(type="text", text=None), part(type="audio", ref="a.ogg", seconds=2.5), part(type="document", ref="d.pdf", pages=3), part(type="hologram", ref="h")]
    df = spark.createDataFrame([(1, 0, "user", parts), (1, 1, "assistant", None), (1, 2, "user", [])], f"conv_id long, turn long, role string, parts {chat.PARTS}")
    flat = {r["turn"]: r for r in chat.flatten_parts(df).collect()}
    assert flat[0]["body"] == "see <\\|<|image:0|><|audio:1|><|document:2|><|hologram:3|>"
    assert [(a["ref"], a["tokens"]) for a in flat[0]["attachments"]] == [("i.png", 3 * 256), ("a.ogg", 63), ("d.pdf", 1536), ("h", 0)]
    assert flat[0]["tokens"] == 768 + 63 + 1536 and flat[1]["body"] == flat[2]["body"] == ""


def test_word_pattern():
    assert WORD == helpers.WORD.pattern
