"""Article bodies put right: rules over arrays of content blocks, as folds inside a row, so a body never leaves its task.

Blocks are structs with type, text, items, url and alt (see sources.html); each function also returns why it removed what it
did, sorted, each reason once. Running counts travel in the folds; what is kept is cut out of the judged array afterwards, so
no fold copies a growing array.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import AUTHOR_TEXT, DEFAULT, Config
from ..functions.text import author_mentioned, bind, blank, boilerplate, collapse, key, near_duplicate, unicode_word_count

PROSE = ("paragraph", "quote")


def spoken(x: Column | str) -> Column:
    """Lower case, single spaces, plain apostrophes: how rules compare texts."""
    return F.replace(F.lower(collapse(x)), F.lit("’"), F.lit("'"))


def _any(x: Column, values: Sequence[str], how: Callable[[Column, Column], Column]) -> Column:
    return F.exists(F.array(*[F.lit(v) for v in values]), lambda v: how(x, v)) if values else F.lit(False)


def items_of(b: Column) -> Column:
    return F.filter(F.transform(F.coalesce(b["items"], F.array().cast("array<string>")), collapse), lambda t: t != "")


def block_text(b: Column) -> Column:
    """What a block says: a list's items, or its text, else what stands for an image."""
    said = F.when(collapse(b["text"]) != "", collapse(b["text"])).otherwise(collapse(b["alt"]))
    return F.when(b["type"] == "list", F.array_join(items_of(b), " ")).otherwise(said)


def utility_reason(x: Column | str, config: Config = DEFAULT) -> Column:
    """Why a text is a publisher's interface and no article; empty where it isn't."""

    return bind(spoken(x), lambda k: _utility(k, config))


def _utility(k: Column, config: Config) -> Column:
    promo = _any(k, config.utility_prefixes, F.startswith) | _any(k, config.utility_contains, F.contains)
    return F.when(k == "", "").when(k.isin(*config.utility_exact), "publisher-ui").when(promo, "publisher-promo").otherwise("")


def terminal_reason(x: Column | str, config: Config = DEFAULT) -> Column:
    return bind(spoken(x), lambda k: _terminal(k, config))


def _terminal(k: Column, config: Config) -> Column:
    return F.when((k != "") & _any(k, config.terminal_prefixes, F.startswith), "recirculation-tail").otherwise("")


def _cut(judged: Column, ends: Callable, words: Callable, counts: Callable, least_words: int, least_blocks: int | None) -> Column:
    """Place (from 0) of the first block that ends an article after enough prose, or -1."""
    start = F.struct(F.lit(0).alias("words"), F.lit(0).alias("blocks"), F.lit(0).alias("i"), F.lit(-1).alias("cut"))

    def step(s, j):
        enough = s["words"] >= least_words
        if least_blocks is not None:
            enough = enough | (s["blocks"] >= least_blocks)
        stop = (s["cut"] < 0) & ends(j) & enough
        return F.struct((s["words"] + words(j)).alias("words"), (s["blocks"] + F.when(counts(j), 1).otherwise(0)).alias("blocks"), (s["i"] + 1).alias("i"), F.when(stop, s["i"]).otherwise(s["cut"]).alias("cut"))

    return F.aggregate(judged, start, step)["cut"]


def _upto(judged: Column, cut: Column) -> Column:
    return F.when(cut < 0, judged).otherwise(F.slice(judged, F.lit(1), F.greatest(cut, F.lit(0))))


def _result(blocks: Column, reasons: Column) -> Column:
    return F.struct(blocks.alias("blocks"), F.array_sort(F.array_distinct(F.filter(reasons, lambda r: r.isNotNull() & (r != "")))).alias("removed"))


def is_promo_image(b: Column, config: Config = DEFAULT) -> Column:
    said = spoken(b["alt"])
    return (utility_reason(b["alt"], config) != "") | _any(spoken(b["url"]), config.promo_url_markers, F.contains) | (F.contains(said, F.lit("preferred source")) & F.contains(said, F.lit("google")))


def is_author_image(b: Column, author: Column, config: Config = DEFAULT) -> Column:
    """An address or a description that belongs to a byline's portrait, or names the author."""
    said = collapse(b["alt"])
    named = author_mentioned(author, b["url"], config.author_stopwords) | ((said != "") & (F.length(said) <= 160) & author_mentioned(author, said, config.author_stopwords))
    return _any(spoken(b["url"]), config.author_url_markers, F.contains) | spoken(b["alt"]).rlike(AUTHOR_TEXT) | named


def enforce(blocks: Column, author: Column, config: Config = DEFAULT) -> Column:
    """The last contract of a body: struct(blocks, removed).

    What ends an article cuts it after 45 words or two blocks of prose and is left out before that. Interface texts,
    embedded media, advertising and portraits go; lists lose such items, and go with their last one.
    """
    plain = lambda t: bind(spoken(t), lambda k: (_utility(k, config) == "") & (_terminal(k, config) == ""))

    def judge(b):
        """What a block says, why it goes and which items stay are computed once each."""
        listed = b["type"] == "list"

        def named(why):
            return (
                F.when(why["end"] != "", why["end"]).when(why["ui"] != "", why["ui"]).when(b["type"] == "media", "embedded-media")
                .when((b["type"] == "image") & is_promo_image(b, config), "promo-image").when((b["type"] == "image") & is_author_image(b, author, config), "author-image").otherwise("")
            )

        def told(x):
            items, reason = x["items"], x["reason"]
            trimmed = listed & (F.size(items) < x["n"])
            gone = (reason != "") | (trimmed & (F.size(items) == 0))
            kept = F.when(trimmed, b.withField("items", items)).otherwise(b)
            words = F.when(gone, 0).when(b["type"].isin(*PROSE), unicode_word_count(b["text"])).when(listed, F.aggregate(items, F.lit(0), lambda t, i: t + unicode_word_count(i))).otherwise(0)
            return F.struct(kept.alias("block"), reason.alias("reason"), gone.alias("gone"), trimmed.alias("trimmed"), words.alias("words"))

        reason = bind(spoken(block_text(b)), lambda k: bind(F.struct(_terminal(k, config).alias("end"), _utility(k, config).alias("ui")), named))
        return bind(bind(items_of(b), lambda items: F.struct(F.filter(items, plain).alias("items"), F.size(items).alias("n"), reason.alias("reason"))), told)

    def finish(judged):
        ends = lambda j: j["reason"] == "recirculation-tail"
        cut = _cut(judged, ends, lambda j: j["words"], lambda j: j["block"]["type"].isin(*PROSE) & (j["words"] > 0), 45, 2)

        def of(c):
            stay = _upto(judged, c)
            reasons = F.concat(F.transform(stay, lambda j: j["reason"]), F.transform(stay, lambda j: F.when(j["trimmed"] & (j["reason"] == ""), "list-publisher-ui")), F.array(F.when(c >= 0, "recirculation-tail")))
            return _result(F.transform(F.filter(stay, lambda j: ~j["gone"]), lambda j: j["block"]), reasons)

        return bind(cut, of)

    return bind(F.transform(blocks, judge), finish)


#: Labels of modules, sentences of interfaces, words of navigation and marks of story cards (fixed values).
MODULE_LABEL = (
    r"(?i)^(?:advertisement|advertising|sponsored(?: content)?|promoted"
    r"|related(?: stories| story| coverage)?|recommended(?: for you)?|you may also like|read more|more from(?: .+)?|more stories|more news|read next|keep reading|also read|trending(?: now)?|most read|most popular|top stories"
    r"|newsletter|newsletters|subscribe|sign up|follow us|follow related authors and topics|interact with .+|report an? .+ error|report a technical issue|editorial code of conduct|comments?)$"
)
UTILITY_SENTENCE = (
    r"(?i)^enjoy the latest .{0,100}news\.?$"
    r"|^(?:sign up|subscribe|get .{0,100} delivered to your inbox|download our app|follow us|share this (?:story|article)|join the conversation|story continues below|continue reading)\b"
    r"|^(?:this )?advertisement(?: has not loaded yet)?\.?$"
    r"|^postmedia is committed to maintaining a lively but civil forum"
    r"|^authors and topics you follow will be added to your personal news feed"
    r"|^(?:report an editorial error|report a technical issue|editorial code of conduct)\.?$"
)
NAV_WORDS = ("home", "news", "canada", "ontario", "quebec", "local", "world", "politics", "business", "sports", "life", "opinion", "entertainment", "health", "weather", "search", "menu", "national", "province", "city")
CARD_META = (
    r"(?i)\bcomments?\b|\bwith\s+video\b|\b\d+\s+(?:minutes?|hours?|days?)\s+ago\b"
    r"|\b(?:jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|jun(?:e)?|jul(?:y)?|aug(?:ust)?|sep(?:tember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)\s+\d{1,2},\s+\d{4}\b"
)


def sentence(x: Column | str) -> Column:
    return (unicode_word_count(collapse(x)) >= 8) & collapse(x).rlike("[.!?][\"'’”)]?$")


def headline(x: Column | str) -> Column:
    """Four to 24 words in 18 to 220 characters that aren't a long sentence with a comma."""
    t, n = collapse(x), unicode_word_count(collapse(x))
    return n.between(4, 24) & F.length(t).between(18, 220) & ~((n >= 15) & sentence(x) & F.contains(t, F.lit(",")))


def sweep(blocks: Column, title: Column, known_titles: Column | None = None, config: Config = DEFAULT, labels: str = MODULE_LABEL, utility: str = UTILITY_SENTENCE, most: int | None = 18) -> Column:
    """The universal sweep: struct(blocks, removed).

    Module labels, interface sentences, navigation lists, lists and runs of story cards, and advertising go; a closing line
    of the publisher's ends the article after 80 words. known_titles: keys of other stories' titles that the body may show. most: see card_runs.
    """
    known = F.array_except(F.coalesce(known_titles, F.array().cast("array<string>")), F.array(key(title))) if known_titles is not None else F.array().cast("array<string>")

    def reason(b, i):
        text = b["type"].isin("paragraph", "heading", "quote") & bind(collapse(block_text(b)), lambda said: said.rlike(labels) | (said.rlike(utility) & (unicode_word_count(said) <= 35)))

        def story_list(items):
            n, count = F.size(items), lambda f: F.size(F.filter(items, f))
            nav = (i <= 1) & n.between(1, 8) & F.forall(items, lambda t: key(t).isin(*NAV_WORDS))
            return nav | ((n >= 2) & ((count(lambda t: F.array_contains(known, key(t))) >= 2) | ((count(lambda t: t.rlike(CARD_META)) >= 2) & (count(headline) >= 2))))

        image = (b["type"] == "image") & (collapse(b["alt"]).rlike(labels) | _any(F.lower(F.concat_ws(" ", b["alt"], b["url"])), config.advert_url_markers, F.contains))
        return F.when(text, "utility-text").when((b["type"] == "list") & bind(items_of(b), story_list), "navigation-or-story-list").when(image, "advert-image").otherwise("")

    judged = F.transform(blocks, lambda b, i: F.struct(b.alias("block"), reason(b, i).alias("reason")))

    def finish(j):
        kept = F.transform(F.filter(j, lambda x: x["reason"] == ""), lambda x: x["block"])

        def of(runs):
            left = F.filter(runs, lambda x: ~x["card"])
            ends = lambda x: key(block_text(x["block"])).isin(*config.closing_keys)
            words = lambda x: F.when(x["block"]["type"].isin(*PROSE), unicode_word_count(x["block"]["text"])).when(x["block"]["type"] == "list", F.aggregate(items_of(x["block"]), F.lit(0), lambda t, v: t + unicode_word_count(v))).otherwise(0)
            cut = _cut(left, ends, words, lambda x: F.lit(False), 80, None)
            reasons = lambda c: F.concat(F.transform(j, lambda x: x["reason"]), F.array(F.when(F.exists(runs, lambda x: x["card"]), "headline-card-run"), F.when(c >= 0, "terminal-publisher-ui")))
            return bind(cut, lambda c: _result(F.transform(_upto(left, c), lambda x: x["block"]), reasons(c)))

        return bind(card_runs(kept, known, most), of)

    return bind(judged, finish)


def card_runs(blocks: Column, known: Column, most: int | None = 18) -> Column:
    """(block, card) for each block: whether it belongs to a run of headlines with images between, or of known titles.

    A run begins with a headline, takes headlines, images and lists of short items, `most` at most; it is one of cards with
    three headlines and two images, or two headlines of known titles. A run that isn't gives its first block back and is
    tried again from the next one. Without a bound (most=None) a run goes on to the next block that can't be in one.
    """

    def kind(b):
        head = b["type"].isin("heading", "paragraph") & headline(b["text"]) & ~((b["type"] == "paragraph") & sentence(b["text"]))
        short = (b["type"] == "list") & (F.size(items_of(b)) > 0) & F.forall(items_of(b), lambda t: unicode_word_count(t) <= 8)
        return F.when(head, "H").when(b["type"] == "image", "I").when(short, "L").otherwise("X")

    kinds = F.transform(blocks, lambda b: F.struct(kind(b).alias("k"), (b["type"].isin("heading", "paragraph") & F.array_contains(known, key(b["text"]))).alias("known")))

    def is_cards(t):
        count = lambda f: F.size(F.filter(t, f))
        heads, images = count(lambda k: k["k"] == "H"), count(lambda k: k["k"] == "I")
        return ((heads >= 2) & (count(lambda k: (k["k"] == "H") & k["known"]) >= 2)) | ((heads >= 3) & (images >= 2))

    def whole(ks):
        """Runs without a bound: where the one from a stretch's first headline is none, no later one is. Each stretch is cut out once."""
        walls = F.concat(F.array(F.lit(-1)), F.filter(F.transform(ks, lambda k, i: F.when(k["k"] == "X", i)), lambda i: i.isNotNull()))

        def told(t):
            first = F.array_position(F.transform(t, lambda k: k["k"]), F.lit("H")).cast("int")
            judge = bind(F.slice(t, F.greatest(first, F.lit(1)), F.size(t)), is_cards) & (first > 0)
            return bind(F.struct(first.alias("first"), judge.alias("cards")), lambda c: F.concat(F.array(F.lit(False)), F.transform(t, lambda k, i: c["cards"] & (i + 1 >= c["first"]))))

        stretch = lambda w: F.flatten(F.transform(w, lambda at, j: bind(F.slice(ks, at + 2, F.coalesce(F.get(w, j + 1), F.size(ks)) - at - 1), told)))
        # the first wall is no block
        return bind(bind(walls, stretch), lambda card: F.transform(blocks, lambda b, i: F.struct(b.alias("block"), F.get(card, i + 1).alias("card"))))

    if most is None:
        return bind(kinds, whole)

    def of(ks):
        def run(i):
            """Length of the run of cards that begins at place i, 0 if there is none."""
            near = F.slice(ks, i + 1, F.lit(most))
            stop = F.array_position(F.transform(near, lambda k: k["k"]), F.lit("X")).cast("int")
            taken = F.when(stop > 0, F.slice(near, F.lit(1), F.greatest(stop - 1, F.lit(0)))).otherwise(near)

            def judge(t):
                return F.when(is_cards(t) & (F.get(t, F.lit(0))["k"] == "H"), F.size(t)).otherwise(0)

            return bind(taken, judge)

        runs = F.transform(ks, lambda k, i: F.when(k["k"] == "H", run(i)).otherwise(0))
        # a run's blocks are no starts of their own: the place up to which the last run reaches is carried along
        reach = F.aggregate(F.transform(runs, lambda n, i: F.struct(n.alias("n"), i.alias("i"))), F.struct(F.lit(0).alias("to"), F.array().cast("array<int>").alias("at")), lambda s, r: bind(F.when((r["i"] >= s["to"]) & (r["n"] > 0), r["i"] + r["n"]).otherwise(s["to"]), lambda to: F.struct(to.alias("to"), F.concat(s["at"], F.array(to)).alias("at"))))["at"]
        return bind(reach, lambda at: F.transform(blocks, lambda b, i: F.struct(b.alias("block"), (F.get(at, i) > i).alias("card"))))

    return bind(kinds, of)


#: What stands before an article on a captured page, and what ends it (fixed values).
PREFIX_CHROME = ("skip to main content", "sections sections", "share current article via", "homepage local canada", "ctv news homepage", "contact us newsletters")
ARTICLE_END = ("report an error", "report an editorial error", "report a technical issue", "editorial standards", "editorial standards & policies", "editorial standards and policies", "why you can trust", "about the author")
SUBSECTIONS = r"^show\s+.{2,100}\s+sub\s+sections\b"


def trim_boundaries(blocks: Column, title: Column, author: Column, ends: Sequence[str] = ARTICLE_END, chrome: Sequence[str] = PREFIX_CHROME) -> Column:
    """The article inside a captured page: struct(blocks, removed).

    The first end mark after 70 words or two blocks of prose ends it. Two signs of page chrome before the first long
    paragraph, or one within the first three blocks, mean that the page's head was captured: the article then starts
    behind its title, or behind its byline, else at the first prose after the chrome.
    """
    norm = lambda x: F.lower(collapse(x))
    is_end = lambda t: bind(norm(t), lambda k: (k != "") & (F.length(k) <= 140) & _any(k, ends, lambda a, m: (a == m) | F.startswith(a, F.concat(m, F.lit(" ")))))
    is_chrome = lambda t: bind(norm(t), lambda k: (k != "") & (_any(k, chrome, F.contains) | k.rlike(SUBSECTIONS)))
    texts = F.transform(blocks, lambda b: bind(block_text(b), lambda t: F.struct(b["type"].alias("type"), norm(t).alias("k"), unicode_word_count(t).alias("n"), is_chrome(t).alias("chrome"), is_end(t).alias("end"))))

    def finish(t):
        counted = lambda j: j["type"].isin("paragraph", "quote", "list")
        cut = _cut(t, lambda j: j["end"], lambda j: F.when(counted(j), j["n"]).otherwise(0), lambda j: counted(j) & (j["n"] > 0), 70, 2)

        def of(c):
            body = F.slice(_upto(t, c), 1, 50)
            places = lambda f: F.filter(F.transform(body, lambda j, i: F.when(f(j), i)), lambda i: i.isNotNull())
            long_ = F.get(places(lambda j: j["type"].isin(*PROSE) & (j["n"] >= 24) & ~j["chrome"]), F.lit(0))

            def begin(m):
                early = F.filter(m["chrome"], lambda i: i <= F.coalesce(m["long"], F.size(body)))
                captured = (F.size(early) >= 2) | ((F.size(early) > 0) & (F.get(early, F.lit(0)) <= 2))
                limit = F.coalesce(m["long"] + 3, F.size(body))
                tk, ak = norm(title), norm(author)
                titled = F.get(F.filter(places(lambda j: (tk != "") & (j["k"] != "") & ((j["k"] == tk) | ((F.length(tk) >= 28) & F.contains(j["k"], tk) & (F.length(j["k"]) <= F.length(tk) + 40)))), lambda i: i < limit), F.lit(0))
                signed = F.get(F.filter(places(lambda j: (ak != "") & F.contains(j["k"], ak) & (F.startswith(j["k"], F.lit("by ")) | (j["k"] == ak) | F.contains(j["k"], F.lit("opens in new window")))), lambda i: i < limit), F.lit(0))
                last = F.element_at(early, -1)
                prose = F.get(F.filter(places(lambda j: j["type"].isin(*PROSE) & (j["n"] >= 18) & ~j["chrome"]), lambda i: (i > last) & (i < last + 18)), F.lit(0))
                start = F.coalesce(F.greatest(titled + 1, signed + 1), prose, F.lit(0))
                return F.when(captured, start).otherwise(0)

            start = bind(F.struct(places(lambda j: j["chrome"]).alias("chrome"), long_.alias("long")), begin)
            return bind(start, lambda s: _result(F.slice(_upto(blocks, c), s + 1, F.greatest(F.size(blocks), F.lit(1))), F.array(F.when(c >= 0, "article-end-boundary"), F.when(s > 0, "article-start-boundary"))))

        return bind(cut, of)

    return bind(texts, finish)


def strip_modules(blocks: Column, starts: str, stops: str = "$^", least_prose: int = 90, most: int | None = 16) -> Column:
    """Recirculation out, by a publisher's patterns over spoken texts: struct(blocks, removed).

    A text that matches `stops` ends the article. One that matches `starts` begins a module, which goes on until a paragraph
    of least_prose characters that reads as prose, or until `most` blocks are skipped.
    """
    judged = F.transform(blocks, lambda b: bind(spoken(block_text(b)), lambda k: F.struct(b.alias("block"), k.rlike(starts).alias("start"), k.rlike(stops).alias("stop"), ((b["type"] == "paragraph") & (F.length(k) >= least_prose) & k.rlike("[.!?][\"'’)]?$")).alias("prose"))))
    bound = 1 << 30 if most is None else most

    def finish(j):
        # the number of blocks skipped in the module under way: 0 outside; -1 once the article has ended
        def step(s, x):
            go_on = (s["now"] > 0) & ~x["prose"] & (s["now"] < bound)
            now = F.when((s["now"] < 0) | x["stop"], -1).when(x["start"], 1).when(go_on, s["now"] + 1).otherwise(0)
            return bind(now, lambda n: F.struct(n.alias("now"), F.concat(s["all"], F.array(n)).alias("all")))

        state = F.aggregate(j, F.struct(F.lit(0).alias("now"), F.array().cast("array<int>").alias("all")), step)["all"]
        return bind(state, lambda a: _result(F.transform(F.filter(j, lambda x, i: F.get(a, i) == 0), lambda x: x["block"]), F.array(F.when(F.exists(a, lambda n: n > 0), "recirculation"), F.when(F.exists(a, lambda n: n < 0), "publisher-stop"))))

    return bind(judged, finish)


def hygiene(blocks: Column, source: Column, rules: dict[str, dict], config: Config = DEFAULT) -> Column:
    """Each source's own rules: rules[source] has starts, stops, least_prose and most for strip_modules, and phrases of its furniture."""
    out = None
    for name, r in rules.items():
        own = {k: v for k, v in r.items() if k != "phrases"}
        phrases = (*config.boilerplate_phrases, *r.get("phrases", ()))
        clean = F.filter(blocks, lambda b: (b["type"] == "image") | ~boilerplate(block_text(b), phrases, config.boilerplate_labels, config.boilerplate_prefixes))

        def stripped(b):
            less = F.when(F.size(b) < F.size(blocks), F.array(F.lit("boilerplate"))).otherwise(F.array().cast("array<string>"))
            return bind(strip_modules(b, **own), lambda x: x.withField("removed", F.array_sort(F.concat(x["removed"], less))))

        done = bind(clean, stripped)
        out = F.when(source == name, done) if out is None else out.when(source == name, done)
    same = _result(blocks, F.array().cast("array<string>"))
    return same if out is None else out.otherwise(same)


def repair_hero(image: Column, blocks: Column, rejected: Column, alt: Column, author: Column, config: Config = DEFAULT) -> Column:
    """The lead image, or the body's first image where it was a portrait or one of the rejected, or empty."""
    said = collapse(alt)
    portrait = F.array_contains(rejected, image) | spoken(said).rlike(AUTHOR_TEXT) | author_mentioned(author, said, config.author_stopwords) | _any(spoken(image), config.author_url_markers, F.contains)
    first = F.get(F.filter(blocks, lambda b: (b["type"] == "image") & (blank(b["url"]) != "")), F.lit(0))["url"]
    return F.when((blank(image) != "") & F.coalesce(portrait, F.lit(False)), F.coalesce(first, F.lit(""))).otherwise(blank(image))


def merge_rich(blocks: Column, candidate: Column, anchors: Column, same=None) -> Column:
    """blocks with the candidate's images and media behind the block that their anchor names, each address once.

    anchors: places in blocks for each candidate block, null where none was found.
    """
    name = lambda b: F.concat_ws(":", b["type"], F.regexp_replace(blank(b["url"]), "#.*$", ""))
    have = F.transform(F.filter(blocks, lambda b: b["type"].isin("image", "media")), name)
    placed = F.filter(F.transform(candidate, lambda b, i: F.struct(F.get(anchors, i).alias("at"), name(b).alias("name"), b.alias("block"))), lambda p: p["block"]["type"].isin("image", "media") & p["at"].isNotNull() & (blank(p["block"]["url"]) != ""))

    def of(p):
        names = F.transform(p, lambda x: x["name"])
        fresh = F.filter(p, lambda x, i: ~F.array_contains(have, x["name"]) & (F.array_position(names, x["name"]) == i + 1))
        return bind(fresh, lambda f: F.flatten(F.transform(blocks, lambda b, i: F.concat(F.array(b), F.transform(F.filter(f, lambda x: x["at"] == i), lambda x: x["block"])))))

    return bind(placed, of)


def unique_texts(blocks: Column, look_back: int = 12) -> Column:
    """Blocks whose text isn't near one of the last few kept."""
    kind = "array<struct<i:int,text:string>>"
    said = F.transform(blocks, lambda b, i: F.struct(i.alias("i"), block_text(b).alias("text")))
    recent = lambda a: F.slice(a, F.greatest(F.lit(1), F.size(a) - look_back + 1), F.lit(look_back))
    kept = F.aggregate(said, F.array().cast(kind), lambda a, x: F.when((x["text"] != "") & F.exists(recent(a), lambda y: near_duplicate(x["text"], y["text"])), a).otherwise(F.concat(a, F.array(x)).cast(kind)))
    return bind(kept, lambda k: F.transform(k, lambda x: F.get(blocks, x["i"])))
