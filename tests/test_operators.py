import datetime as dt

from pyspark.sql import functions as F

from broadsheet.config import DEFAULT
from broadsheet.operators import aggregates, audit, blocks, cluster, filters, merge, search, windows
from broadsheet.sources import feeds, html, snapshot
from broadsheet.sources.tables import now
from broadsheet.streaming.incremental import Snapshot, deduplicated, read_files, run_incremental, windowed_counts

T = dt.datetime(2024, 6, 1)


def test_retention_boundary(spark):
    at = now("2024-06-08 00:00:00")
    df = spark.createDataFrame([(1, T), (2, T + dt.timedelta(microseconds=1)), (3, None)], "id long, published timestamp")
    assert [r["id"] for r in filters.retained(df, at).collect()] == [2]


def test_gate_keeps_reasons(spark):
    df = spark.createDataFrame([("a", "x", 10), ("a", "x", 40), ("b", "x", None), ("c", "x", 1)], "source string, title string, local_score int")
    got = {(r["source"], r["local_score"]): r["drop_reason"] for r in filters.gate(df, {"a": 30}, retired=("b",)).collect()}
    assert got == {("a", 10): "local score", ("a", 40): None, ("b", None): "retired source", ("c", 1): None}


def test_home_feed_hides_only_wholly_hidden_clusters(spark):
    df = spark.createDataFrame([(1, True, ["A", "B"]), (2, True, ["A"]), (3, False, ["B"])], "id int, cluster_representative boolean, cluster_sources array<string>")
    assert [r["id"] for r in filters.home_feed(df, hidden=("a",)).collect()] == [1]


def test_protected_merge_removes_absent_body(spark):
    fresh = spark.createDataFrame([(1, "new", "short"), (2, "new", "body")], "id int, title string, content string")
    current = spark.createDataFrame([(1, "old", None), (3, "old", "kept")], "id int, title string, content string")
    got = {r["id"]: (r["title"], r["content"], r["preserved"]) for r in merge.protected_full(fresh, current, "id", ["content"], F.lit(True)).collect()}
    assert got == {1: ("new", None, True), 2: ("new", "body", False), 3: ("old", "kept", True)}


def test_last_wins(spark):
    df = spark.createDataFrame([(1, 1, "a"), (1, 3, "c"), (1, 2, "b"), (2, 1, None)], "id int, seq int, v string")
    assert sorted((r["id"], r["v"]) for r in merge.last_wins(df, ["id"], ["seq"]).collect()) == [(1, "c"), (2, None)]


def test_lookup_prefers_id(spark):
    old = spark.createDataFrame([("1", "u1", "by id"), ("9", "u2", "by url")], "id string, url string, v string")
    new = spark.createDataFrame([("1", "u2"), ("2", "u2"), ("3", "u3")], "id string, url string")
    assert {r["id"]: r["old_v"] for r in merge.lookup_existing(new, old, ["v"]).collect()} == {"1": "by id", "2": "by url", "3": None}


def test_gap_dedupe_counts_from_the_last_kept(spark):
    rows = [("k", T + dt.timedelta(days=d), d) for d in (0, 5, 9, 14)]
    df = spark.createDataFrame(rows, "key string, ts timestamp, id int")
    assert sorted(r["id"] for r in windows.gap_dedupe(df, ["key"], "ts", "id", 7 * 86400).collect()) == [5, 14]


def test_runs_and_tails(spark):
    df = spark.createDataFrame([(["a", "i", "i", "b", "i"],)], "x array<string>")
    assert df.select(windows.run_in_array(F.col("x"), lambda v: v == "i").alias("r")).first()["r"] == 2
    assert df.select(windows.tail(F.col("x")).alias("t")).first()["t"] == ["b", "i"]


def test_look_back_is_bounded(spark):
    long = "this is a long enough line of text to count"
    df = spark.createDataFrame([([long, "b", long, "c", "d", long],)], "x array<string>")
    assert df.select(windows.drop_recent_repeats(F.col("x"), 2).alias("k")).first()["k"] == [long, "b", "c", "d", long]


def test_band_join_meets_each_pair_once(spark):
    rows = [(i, 1, T + dt.timedelta(hours=h)) for i, h in enumerate((0, 10, 36, 37, 80))]
    e = spark.createDataFrame(rows, "id int, u int, ts timestamp")
    got = sorted((r["id"], r["other_id"]) for r in cluster.band_join(e, e, ["u"], "ts", 36 * 3600).where("id < other_id").collect())
    assert got == [(a, b) for a, _, x in rows for b, _, y in rows if a < b and (y - x) <= dt.timedelta(hours=36)]


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(10, 40)], "a long, b long")
    nodes = spark.range(8, 42)
    got = {r["id"]: r["component"] for r in cluster.components(edges, nodes).collect()}
    assert got[8] == 8 and got[41] == 41 and {got[i] for i in range(10, 41)} == {10}


def test_audit_rules(spark):
    df = spark.createDataFrame([(1, "s", "", "ftp://x", None, "full", 10, "so it ends...", 20)], "id int, source string, title string, url string, published timestamp, content_status string, words int, content string, quality int")
    got = audit.scored(audit.issues(df, now())).first()
    assert [i["code"] for i in got["issues"]] == ["missing_title", "invalid_url", "missing_date", "status_mismatch", "low_quality"]
    assert got["audit_score"] == 0 and got["audit_status"] == "fail"


def test_cluster_covered_summary(spark):
    df = spark.createDataFrame([(1, "a", "c1"), (2, "b", "c2")], "id int, source string, cluster_id string")
    df = df.withColumn("issues", F.array(F.struct(F.lit("warning").alias("severity"), F.lit("short_body").alias("code"), F.lit("x").alias("message"))))
    complete = spark.createDataFrame([("c1", ["b"]), ("c2", ["b"])], "cluster_id string, complete_sources array<string>")
    got = {r["id"]: r["issues"][0]["code"] for r in audit.cluster_aware(df, complete).collect()}
    assert got == {1: "cluster_covered_summary", 2: "short_body"}


def test_source_health_status(spark):
    rows = [("a", "full", 80, False, T)] * 8 + [("a", "failed", 0, True, T)] * 2 + [("b", "full", 80, False, T)]
    df = spark.createDataFrame(rows, "source string, content_status string, quality int, error boolean, published timestamp")
    got = {r["source"]: r["status"] for r in aggregates.source_health(df, [F.col("published")]).collect()}
    assert got == {"a": "degraded", "b": "healthy"}


def test_repeated_value(spark):
    rows = [("a", "logo", i) for i in range(3)] + [("a", f"x{i}", 10 + i) for i in range(3)] + [("b", "y", 1)]
    df = spark.createDataFrame(rows, "source string, image string, i int")
    assert [(r["source"], r["image"], r["n"]) for r in aggregates.repeated_values(df, "source", "image", [F.col("i")]).collect()] == [("a", "logo", 3)]


PAGE = "<html><title>T</title><nav><ul><li>menu</li></ul></nav><h2>Head</h2><p>One <b>two</b><p>Three &amp; four</p><script>var x='<p>no</p>'</script><ul><li>a<li>b</ul><img src='i.jpg' alt='z'><a href='/a/b?x=1'>l</a><a href='https://other.example/c'>m</a>"


def test_html_blocks():
    got = [(b["type"], b["text"], b["items"], b["url"]) for b in html.blocks_of(PAGE)]
    assert got == [("heading", "Head", None, None), ("paragraph", "One two", None, None), ("paragraph", "Three & four", None, None), ("list", None, ["a", "b"], None), ("image", None, None, "i.jpg")]
    assert html.blocks_of(None) == [] and html.blocks_of("") == []


def test_block_transforms(spark):
    df = html.with_blocks(spark.createDataFrame([(1, PAGE)], "page_id int, html string"))
    b = F.col("content_blocks")
    got = df.select(blocks.paragraphs(b).alias("p"), blocks.stats(b).alias("s"), blocks.sanitize(b, "^head$").alias("c"), F.size(blocks.unique(F.concat(b, b))).alias("u")).first()
    assert got["p"] == ["Head", "One two", "Three & four", "a", "b"] and got["s"]["words"] == 8 and got["s"]["images"] == 1
    assert got["c"] == [] and got["u"] == 5


def test_fragments_and_walls(spark):
    df = spark.createDataFrame([(["It began", "and went on.", "New one."],)], "p array<string>")
    assert df.select(blocks.repair_fragments(F.col("p")).alias("x")).first()["x"] == ["It began and went on.", "New one."]
    wall = " ".join(["Many words stand in this sentence here."] * 30)
    got = spark.range(1).select(blocks.split_wall(F.lit(wall)).alias("x")).first()["x"]
    assert " ".join(got) == wall and len(got) == 2


def test_page_links(spark):
    df = spark.createDataFrame([(1, "https://a.example/", PAGE)], "page_id int, url string, html string")
    assert [r["link"] for r in feeds.page_links(df).collect()] == ["https://a.example/a/b"]


def test_feed_entries(spark):
    rss = "<rss><channel><item><title>A &amp; B</title><link>https://x.example/1?utm=2</link><description>&lt;p&gt;Text&lt;/p&gt;</description><pubDate>Fri, 01 Mar 2024 10:00:00 GMT</pubDate></item><item><title>C</title></item></channel></rss>"
    atom = '<feed xmlns="http://www.w3.org/2005/Atom"><entry><title>D</title><link href="https://x.example/2"/><updated>2024-03-01T10:00:00Z</updated></entry></feed>'
    df = spark.createDataFrame([("s", rss), ("t", atom), ("u", "<broken"), ("v", None)], "source string, xml string")
    got = {(r["source"], r["position"]): (r["title"], r["url"], r["summary"]) for r in feeds.feed_entries(df).collect()}
    assert got == {("s", 0): ("A & B", "https://x.example/1", "Text"), ("s", 1): ("C", "", ""), ("t", 0): ("D", "https://x.example/2", "")}


def test_fallback_routes(spark):
    df = spark.createDataFrame([("a", 2, "x"), ("a", 2, "y"), ("b", 1, "z"), ("b", 3, "w")], "source string, route int, url string")
    assert sorted(r["url"] for r in feeds.first_route(df, ["source"]).collect()) == ["x", "y", "z"]


def test_snapshot_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a", T, 1), ("b", T + dt.timedelta(1), 2)], "id string, published timestamp, v int")
    snapshot.write_snapshot(df, f"{tmp_path}/s", "json")
    assert sorted(r["id"] for r in snapshot.read_snapshot(spark, f"{tmp_path}/s", df.schema).collect()) == ["a", "b"]
    assert snapshot.read_snapshot(spark, f"{tmp_path}/none", df.schema).count() == 0
    snapshot.write_parts(df, f"{tmp_path}/p")
    assert [r["v"] for r in snapshot.lookup(spark, f"{tmp_path}/p", "id", "b").collect()] == [2]


def test_search_prefix_and_typos(spark):
    df = spark.createDataFrame([(1, "hospital opens", "x"), (2, "hospitals close", "hospital"), (3, "hospitel", "y")], "id int, title string, summary string")
    inverted = search.index(df, ["title", "summary"])
    assert {r["id"]: r["score"] for r in search.ranked(inverted, "hospital").collect()} == {1: 5.0, 2: 5.0}
    assert {r["id"] for r in search.ranked(inverted, "hospital", fuzzy=0.22).collect()} == {1, 2, 3}


def test_forward_only(spark):
    df = spark.createDataFrame([("a", T), ("b", T)], "k string, published timestamp")
    index = spark.createDataFrame([("a", T + dt.timedelta(hours=1)), ("b", T - dt.timedelta(hours=1))], "k string, published timestamp")
    got = {r["k"]: r["moved"] for r in merge.forward_only(df, index, "k", now("2024-06-01 02:00:00")).collect()}
    assert got == {"a": True, "b": False}


def test_stream_replays_are_idempotent(spark, tmp_path):
    rows = spark.createDataFrame([(1, T, 5), (2, T, 6)], "event_id int, ts timestamp, v int")
    state = Snapshot(spark, f"{tmp_path}/snap")
    state.merge(rows, 0, ["event_id"], ["ts"])
    state.merge(rows.withColumn("v", F.lit(99)), 0, ["event_id"], ["ts"])
    state.merge(rows.where("event_id = 1").withColumn("v", F.lit(7)).withColumn("ts", F.col("ts") + F.expr("INTERVAL 1 DAY")), 1, ["event_id"], ["ts"])
    assert {r["event_id"]: r["v"] for r in state.read().collect()} == {1: 7, 2: 6}


def test_streams(spark, small, tmp_path):
    events = read_files(spark, f"{small}/events.parquet")
    state = Snapshot(spark, f"{tmp_path}/s")
    run_incremental(spark, events, state, ["event_id"], ["ts"], checkpoint=f"{tmp_path}/c").awaitTermination()
    assert state.read().count() == spark.read.parquet(f"{small}/events.parquet").select("event_id").distinct().count()
    for n, df in enumerate((deduplicated(events, ["user_id"]), windowed_counts(events, "event_type"))):
        q = df.writeStream.format("memory").queryName(f"q{n}").outputMode("append").option("checkpointLocation", f"{tmp_path}/m{n}").trigger(availableNow=True).start()
        q.awaitTermination()
        assert spark.sql(f"select * from q{n}").count() > 0


def test_config_is_immutable():
    assert DEFAULT.with_(retention_days=3).retention_days == 3 and DEFAULT.retention_days == 7


def test_redirects_json_ld_and_shells(spark):
    page = '<a href="/own">o</a><a href="https://b.example/1">b</a><a href="https://n.c.example/2">c</a><script type="application/ld+json">{"@graph":[{"@type":"Org","name":"x"},{"@type":"NewsArticle","headline":"H"}]}</script><script type="application/ld+json">[{"@type":"A"}]</script>'
    df = spark.createDataFrame([(page, "https://a.example/")], "html string, url string")
    got = df.select(feeds.first_outbound("html", "url", "c.example").alias("c"), feeds.first_outbound("html", "url", "z.example").alias("z"), F.size(feeds.json_ld("html")).alias("n"), feeds.json_ld_field("html", "headline").alias("h"), html.social_shell(F.lit('A "b" <c>'), F.lit("s"), "url", F.lit(None).cast("string")).alias("s")).first()
    assert (got["c"], got["z"], got["n"], got["h"]) == ("https://n.c.example/2", "https://b.example/1", 3, "H")
    assert got["s"].startswith("<title>A &quot;b&quot; &lt;c&gt;</title>") and "og:image" not in got["s"]


def test_nearest_title(spark):
    from broadsheet.operators import linkage

    items = spark.createDataFrame([(1, "Council approves the new budget"), (2, "Fire"), (3, "Nothing like it")], "id int, title string")
    index = spark.createDataFrame([(10, "Council approves the new budgets"), (11, "Council approves a budget"), (12, "fire!")], "ref int, title string")
    assert {(r["id"], r["ref"]) for r in linkage.nearest_title(items, index).collect()} == {(1, 10), (2, 12)}


def test_expired_parts_stay_empty(spark, tmp_path):
    """A part whose rows have all passed the horizon is empty from then on, and fills again with new rows."""
    state = Snapshot(spark, f"{tmp_path}/s", parts=2)
    rows = lambda *x: spark.createDataFrame(x, "id long, day int, text string")
    old = [(i, 10, "old") for i in range(8)]
    state.merge(rows(*old), 0, ["id"], ["day"])
    assert state.read().count() == 8
    state.merge(rows(*[(i, 5, "late") for i in range(8)]), 1, ["id"], ["day"], F.col("day") >= 20)
    assert state.read() is None
    state.merge(rows((3, 25, "new")), 2, ["id"], ["day"], F.col("day") >= 20)
    assert [tuple(r) for r in state.read().select("id", "day", "text").collect()] == [(3, 25, "new")]
    state.merge(rows((3, 26, "replayed")), 2, ["id"], ["day"])
    assert state.read().first()["text"] == "new"


def test_json_ld_at_any_depth(spark):
    page = '<script type="application/ld+json">{"@graph":[{"@type":"Org"},{"@graph":[{"@type":"Deep","@graph":[[{"@type":"Deeper"}]]}]},[{"@type":"Listed"}]]}</script><script type="application/ld+json">no json {</script><script type="application/ld+json">{"@type":"Plain"}</script>'
    df = spark.createDataFrame([(page,), (None,), ("<p>none</p>",)], "html string")
    got = [r["k"] for r in df.select(F.transform(feeds.json_ld("html"), lambda j: F.get_json_object(j, "$['@type']")).alias("k")).collect()]
    assert got[0] == ["Org", "Deep", "Listed", "Deeper", "Plain"] and got[1] in (None, []) and got[2] == []
