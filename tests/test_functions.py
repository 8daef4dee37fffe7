from difflib import SequenceMatcher

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from broadsheet.config import DEFAULT
from broadsheet.functions import dates, scores, similarity, text, urls


def one(spark, c, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()] or ["id"]).select(c.alias("x")).first()["x"]


@pytest.mark.parametrize("given_, want", [("  a \n\t b ", "a b"), (None, ""), ("", "")])
def test_collapse(spark, given_, want):
    assert one(spark, text.collapse(F.lit(given_).cast("string"))) == want


def test_clean_unescapes_before_tags_go(spark):
    assert one(spark, text.clean(F.lit("<p>Fish &amp; chips</p>&nbsp;now"))) == "Fish & chips now"
    assert one(spark, text.clean(F.lit("one, two three"), 6)) == "one…"


def test_tokens(spark):
    assert one(spark, text.tokens(F.lit("The council's 2024 budget, budget and ice-cream"), DEFAULT.stopwords)) == ["council's", "budget", "ice-cream"]


def test_terms_are_whole_words(spark):
    assert one(spark, text.has_term(F.lit("the courtyard"), "court")) is False
    assert one(spark, text.has_term(F.lit("in court today"), "court")) is True


@pytest.mark.parametrize("title, want", [("Fire downtown - Daily News", "Fire downtown"), ("Fire - downtown", "Fire - downtown")])
def test_strip_source(spark, title, want):
    assert one(spark, text.strip_source(F.lit(title), F.lit("Daily News"))) == want


@pytest.mark.parametrize("url, want", [("https://a.example/x/?q=1#top", "https://a.example/x"), ("https://a.example/", "https://a.example"), (None, "")])
def test_canonical(spark, url, want):
    assert one(spark, urls.canonical(F.lit(url).cast("string"))) == want


@pytest.mark.parametrize("url, want", [("/b", "https://a.example/b"), ("//c.example/d", "https://c.example/d"), ("e", "https://a.example/x/e"), ("https://f.example/", "https://f.example/")])
def test_resolve(spark, url, want):
    assert one(spark, urls.resolve(F.lit(url), F.lit("https://a.example/x/y"))) == want


def test_image_keys(spark):
    a, b = "https://a.example/i/pic-300x200.jpg?w=300&v=2", "https://a.example/i/pic-900x600.jpg?v=2&w=900"
    assert one(spark, urls.image_key(F.lit(a))) == "https://a.example/i/pic-300x200.jpg?v=2"
    assert one(spark, urls.same_image(F.lit(a), F.lit(b))) is True


def test_srcset(spark):
    assert one(spark, urls.srcset_best(F.lit("a.jpg 300w, b.jpg 900w, c.jpg 600w"))) == "b.jpg"


@pytest.mark.parametrize(
    "value, want",
    [("2024-03-01T10:00:00Z", "2024-03-01 10:00:00"), ("2024-03-01T10:00:00", "2024-03-01 15:00:00"), ("Fri, 01 Mar 2024 10:00:00 GMT", "2024-03-01 10:00:00"), ("Fri, 01 Mar 2024 10:00:00 +0200", "2024-03-01 08:00:00"), ("never", None), (None, None)],
)
def test_dates(spark, value, want):
    got = one(spark, dates.parse(F.lit(value).cast("string"), "America/Toronto").cast("string"))
    assert got == want


def test_freshness_of_the_future_is_full(spark):
    now = F.lit("2024-01-01 00:00:00").cast("timestamp")
    assert one(spark, dates.freshness(now, F.lit("2024-01-02 00:00:00").cast("timestamp"), DEFAULT.freshness)) == 100
    assert one(spark, dates.freshness(now, F.lit(None).cast("timestamp"), DEFAULT.freshness)) == 0


def test_rank_rounds_half_to_even(spark):
    assert one(spark, scores.rank(F.lit(50), F.lit(0), F.lit(0), F.lit(0), F.lit(0))) == 12


def test_local_relevance(spark):
    score, why = scores.local_relevance(F.lit("London Police and the Thames River"), F.lit(10), DEFAULT)
    assert one(spark, score) == 10 + 28 + 8
    assert one(spark, why) == ["London Police +28", "local publisher +10", "London landmark +8"]
    score, _ = scores.local_relevance(F.lit("Westminster UK, London England"), F.lit(55), DEFAULT)
    assert one(spark, score) == 0


@settings(max_examples=60, deadline=None)
@given(st.text("abcd ", max_size=70), st.text("abcd ", max_size=70))
def test_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        prev = 0
        for j, y in enumerate(b):
            prev, row[j + 1] = row[j + 1], prev + 1 if x == y else max(row[j + 1], row[j])
    assert similarity.lcs_length(a, b) == row[-1]


def test_similarity_udfs(spark):
    df = spark.createDataFrame([("fire on main street", "main street fire"), ("", ""), (None, "x")], "a string, b string")
    got = df.select(similarity.indel_ratio("a", "b").alias("i"), similarity.token_set_ratio("a", "b").alias("t"), similarity.sequence_ratio("a", "b").alias("s")).collect()
    assert got[0]["t"] == 1.0 and got[0]["s"] == SequenceMatcher(None, "fire on main street", "main street fire").ratio()
    assert got[1]["i"] == 1.0 and got[2]["i"] == 0.0


def test_sentence_case(spark):
    got = one(spark, text.sentence_case(F.lit("CBC NEWS FROM LONDON | Plain Words Here"), ("CBC",), ("London",)))
    assert got == "CBC news from London | Plain Words Here"


def test_summary_without_echo(spark):
    title = "Council approves the new budget"
    assert one(spark, text.summary_text(F.lit(f"{title} - {title}: It costs more than the last."), F.lit(title))) == "It costs more than the last."
    assert one(spark, text.summary_text(F.lit(title), F.lit(title))) == ""


def test_markdown(spark):
    got = one(spark, text.markdown_blocks(F.lit("# Head **x**\n\nSome [link](u) text\n\n- a\n- b\n\n> said\n\n![alt](i.png)")))
    assert [(b["type"], b["text"], b["level"], b["items"], b["url"]) for b in got] == [("heading", "Head x", 1, None, None), ("paragraph", "Some link text", None, None, None), ("list", None, None, ["a", "b"], None), ("quote", "said", None, None, None), ("image", "alt", None, None, "i.png")]


def test_anchor(spark):
    texts = F.array(*[F.lit(x) for x in ("first words here", "the mayor spoke about housing costs", "last")])
    assert one(spark, text.match_anchor(texts, F.lit("Mayor spoke about housing"))) == 1
    assert one(spark, text.match_anchor(texts, F.lit("entirely different matter"))) is None


def test_image_rating(spark):
    assert one(spark, urls.image_rating(F.lit("https://a.example/p/photo.jpg?w=800"))) == 90
    assert one(spark, urls.image_rating(F.lit("https://a.example/p/site-logo.png"))) == 0
