"""Text functions as column expressions. Null counts as empty text throughout."""

from __future__ import annotations

from collections.abc import Sequence
from html.entities import name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def blank(x: Column | str) -> Column:
    return F.coalesce(col(x), F.lit(""))


def bind(value: Column, f) -> Column:
    """f(value) with value computed once, however often f names it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def rewrite(x: Column, pattern: str, f) -> Column:
    """x with every match of a pattern replaced by f(match), a column expression."""

    def put(v: Column) -> Column:
        both = F.arrays_zip(F.split(v, pattern, -1).alias("gap"), F.regexp_extract_all(v, F.lit(pattern), F.lit(0)).alias("hit"))
        return F.array_join(F.transform(both, lambda z: F.concat(z["gap"], F.coalesce(f(z["hit"]), F.lit("")))), "")

    return bind(x, put)


def _spaced(x: Column, gap: str) -> Column:
    """Runs of spaces and a class of other characters as one space, none at the ends. Spaces that stand alone, which are most, stay where they are."""
    return F.trim(F.regexp_replace(F.regexp_replace(x, gap, " "), "  +", " "))


def collapse(x: Column | str) -> Column:
    """White space runs as one space, none at the ends."""
    return _spaced(blank(x), r"[\t\n\x0B\f\r\u00A0]+")


def unescape(x: Column | str) -> Column:
    """Named and numbered entities as characters, each once; unknown ones stay."""
    known = F.create_map(*[F.lit(v) for name, code in [*sorted(name2codepoint.items()), ("apos", 39)] for v in (name, chr(code))])

    def character(e: Column) -> Column:
        hexed = F.regexp_extract(e, "^&#[xX]([0-9A-Fa-f]{1,6});$", 1)
        number = F.coalesce(F.nullif(hexed, F.lit("")), F.hex(F.regexp_extract(e, "^&#([0-9]{1,7});$", 1).try_cast("int")))
        valid = number.isNotNull() & F.conv(number, 16, 10).cast("long").between(1, 0x10FFFF) & ~F.conv(number, 16, 10).cast("long").between(0xD800, 0xDFFF)
        point = F.decode(F.unhex(F.lpad(F.when(valid, number), 8, "0")), "UTF-32")
        return F.coalesce(point, F.try_element_at(known, F.regexp_extract(e, "^&([A-Za-z0-9]+);$", 1)), e)

    out = blank(x)
    return F.when(F.contains(out, F.lit("&")), rewrite(out, "&(?:#[0-9]{1,7}|#[xX][0-9A-Fa-f]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});", character)).otherwise(out)


def truncate(x: Column, limit: int) -> Column:
    """At most limit characters, an ellipsis for what is left out."""
    cut = F.regexp_replace(F.substring(x, 1, limit - 1), r"[ ,;:\-]+$", "")
    return F.when(F.length(x) <= limit, x).otherwise(F.concat(cut, F.lit("…")))


def clean(x: Column | str, limit: int | None = None) -> Column:
    """Entities, then tags, then white space, then the limit."""
    out = collapse(F.regexp_replace(unescape(x), r"<[^>]*>", " "))
    return truncate(out, limit) if limit else out


def key(x: Column | str) -> Column:
    """Comparison key: lower case, runs of anything but a-z and 0-9 as one space."""
    return _spaced(F.lower(blank(x)), "[^a-z0-9 ]+")


def comparison_key(x: Column | str) -> Column:
    """The key of the cleaned text: entities and tags don't count."""
    return key(clean(x))


def apostrophe_key(x: Column | str) -> Column:
    """As key, with apostrophes kept and typographic ones made plain."""
    return _spaced(F.lower(F.replace(blank(x), F.lit("’"), F.lit("'"))), "[^a-z0-9' ]+")


def tokens(x: Column | str, stopwords: Sequence[str], least: int = 4) -> Column:
    """Distinct tokens of some length that are neither stopwords nor numbers, in order of first appearance; typographic apostrophes are plain ones."""
    plain = F.replace(F.lower(blank(x)), F.lit("’"), F.lit("'"))
    found = F.array_distinct(F.regexp_extract_all(plain, F.lit("([a-z0-9]+(?:['-][a-z0-9]+)?)"), F.lit(1)))
    stop = F.array(*[F.lit(s) for s in stopwords])
    return F.filter(F.array_except(found, stop), lambda t: (F.length(t) >= least) & ~t.rlike("^[0-9]+$"))


def word_count(x: Column | str) -> Column:
    """Words of ASCII letters and digits, with inner apostrophes and hyphens."""
    joined = F.regexp_replace(blank(x), "['’-](?<=[A-Za-z0-9].)(?=[A-Za-z0-9])", "a")
    return _runs_left(joined, "[^A-Za-z0-9 ]+")


def split_count(x: Column | str) -> Column:
    """Runs of anything but white space."""
    return _runs_left(blank(x), r"[\t\n\r\f\x0B]+")


def _runs_left(x: Column, gap: str) -> Column:
    """How many runs of anything but a class of characters there are: the spaces that keep them apart, and one, without a list of them."""
    return bind(_spaced(x, gap), lambda v: F.when(v == "", 0).otherwise(F.length(v) - F.length(F.replace(v, F.lit(" "))) + 1))


def unicode_word_count(x: Column | str) -> Column:
    """Words of letters, digits and underscores of any script."""
    return F.regexp_count(blank(x), F.lit(r"(?U)\b[\w’'-]+\b"))


def phrase_hits(text_key: Column, phrases: Sequence[str]) -> Column:
    """The phrases that stand in a key as whole words, in the order given."""
    listed = F.array(*[F.lit(p) for p in phrases])
    return bind(F.concat(F.lit(" "), text_key, F.lit(" ")), lambda padded: F.filter(listed, lambda p: F.contains(padded, F.concat(F.lit(" "), p, F.lit(" ")))))


def spelled(term: str) -> str:
    """A term as keys spell it: hyphens and points are spaces."""
    return " ".join(term.lower().replace("-", " ").replace(".", " ").split())


def has_term(text: Column, term: str) -> Column:
    """Whether a term stands in lower-case text, not inside a longer word."""
    import re

    return text.rlike(f"(?<![a-z0-9]){re.escape(term)}(?![a-z0-9])")


def classify(text: Column, rules: Sequence[tuple[str, Sequence[str]]], other: str = "Local", bounded: bool = False, first: Sequence[tuple[str, Sequence[str]]] = ()) -> Column:
    """The first rule with a needle in the text: as a substring, or as a whole term. Rules in `first` go before all and take whole terms."""
    import re
    from functools import reduce

    def of(lowered: Column) -> Column:
        out = None
        for name, needles, whole in [*((n, x, True) for n, x in first), *((n, x, bounded) for n, x in rules)]:
            # plain searches are cheap: a pattern only runs where a needle stands at all
            hit = reduce(lambda a, b: a | b, [F.contains(lowered, F.lit(n)) for n in needles])
            if whole:
                hit &= lowered.rlike(f"(?<![a-z0-9])(?:{'|'.join(re.escape(n).replace(chr(92) + ' ', ' ') for n in needles)})(?![a-z0-9])")
            out = F.when(hit, name) if out is None else out.when(hit, name)
        return out.otherwise(other)

    return bind(F.replace(F.lower(blank(text)), F.lit("’"), F.lit("'")), of)


def strip_source(title: Column | str, source: Column | str) -> Column:
    """A title without " - Source" or " | Source" at its end."""
    t, s = collapse(title), blank(source)
    ends = [F.concat(F.lit(sep), s) for sep in (" - ", " | ", " – ")]
    out = t
    for e in ends:
        out = F.when((s != "") & F.endswith(F.lower(out), F.lower(e)), F.trim(F.substring(out, F.lit(1), F.length(out) - F.length(e)))).otherwise(out)
    return out


def clean_summary(summary: Column | str, title: Column | str) -> Column:
    """A summary, empty where it only says the title again."""
    s = collapse(summary)
    return F.when(key(s) == key(title), "").otherwise(s)


def first_words(x: Column | str, n: int = 20) -> Column:
    """The first n words, an ellipsis if there are more."""
    words = F.split(collapse(x), " ")
    return F.when(F.size(words) <= n, collapse(x)).otherwise(F.concat(F.array_join(F.slice(words, 1, n), " "), F.lit("…")))


def sentence_like(x: Column | str) -> Column:
    """Eight words or more, ending as a sentence does."""
    return (word_count(x) >= 8) & collapse(x).rlike("[.!?…][\"'”’)]*$")


def headline_like(x: Column | str) -> Column:
    """Four to eighteen words without a sentence's end."""
    return word_count(x).between(4, 18) & ~collapse(x).rlike("[.!?…][\"'”’)]*$")


def split_words(x: Column | str) -> Column:
    """camelCase and attribute-names as words."""
    return F.lower(F.trim(F.regexp_replace(F.regexp_replace(blank(x), "([a-z])([A-Z])", "$1 $2"), "[^A-Za-z0-9]+", " ")))


def topics(category: Column, labels: Column, flags: Column, most: int = 5) -> Column:
    """Category, labels and flags in order, each once, the first few."""
    return F.slice(F.array_distinct(F.filter(F.concat(F.array(category), labels, flags), lambda t: t.isNotNull() & (t != ""))), 1, most)


def near_duplicate(a: Column, b: Column, share: float = 0.58, least: int = 28) -> Column:
    """Equal keys, or one is a prefix of the other of some length and share. (similarity.near_duplicate adds the rule of ratios.)"""

    def near(z: Column) -> Column:
        x, y = F.get(z, F.lit(0)), F.get(z, F.lit(1))
        begins = lambda small, large: (F.length(small) >= least) & F.startswith(large, small) & (F.length(small) >= F.length(large) * share)
        return (x != "") & (y != "") & ((x == y) | begins(x, y) | begins(y, x))

    return bind(F.array(key(a), key(b)), near)


_SEGMENT = r"\s+[|•]\s+"
_TERM = r"[A-Za-z0-9]+(?:[-’'][A-Za-z0-9]+)?"


def sentence_case(x: Column | str, acronyms: Sequence[str], proper: Sequence[str], share: float = 0.8) -> Column:
    """Segments (between bars or bullets) written in capitals, as sentences; single words in capitals, as words.

    Acronyms and proper words get their form back, and so does ", ON". Segments of fewer than eight letters stay.
    """
    known = F.create_map(*[F.lit(v) for w in (*acronyms, *proper) for v in (w.lower(), w)])
    kept = F.array(*[F.lit(a) for a in acronyms])
    every = "|".join(sorted((*acronyms, *proper), key=len, reverse=True))

    def restored(v):
        named = rewrite(v, rf"(?i)\b(?:{every})\b", lambda w: F.try_element_at(known, F.lower(w)))
        return F.regexp_replace(named, r"(?i),\s+on\b", ", ON")

    def segment(v):
        letters, capitals = (F.length(F.regexp_replace(v, kind, "")) for kind in (r"\P{L}+", r"\P{Lu}+"))
        shouted = rewrite(F.lower(v), r"(?:^|[.!?]\s+)[a-z]", F.upper)
        mixed = rewrite(v, r"\b[A-Z][A-Z'’]{3,}\b", lambda w: F.when(F.array_contains(kept, w), w).otherwise(F.concat(F.substring(w, 1, 1), F.lower(F.substring(w, F.lit(2), F.length(w))))))
        loud = bind(letters, lambda n: F.when(n >= 8, capitals >= n * share))  # null: too few letters
        return bind(loud, lambda yes: F.when(yes.isNull(), v).otherwise(restored(F.when(yes, shouted).otherwise(mixed))))

    def parts(v):
        both = F.arrays_zip(F.split(v, _SEGMENT, -1).alias("part"), F.regexp_extract_all(v, F.lit(_SEGMENT), F.lit(0)).alias("bar"))
        return F.array_join(F.transform(both, lambda z: F.concat(segment(z["part"]), F.coalesce(z["bar"], F.lit("")))), "")

    return bind(collapse(x), parts)


def title_stems(title: Column | str) -> Column:
    """A title's first segment, and the same without a file number at its end, the longer first."""

    def stems(base):
        both = lambda bare: F.when(base == "", F.array().cast("array<string>")).when((F.length(bare) >= 18) & (bare != base), F.array(base, bare)).otherwise(F.array(base))
        return bind(F.trim(F.regexp_replace(base, r"\s+\d{2,4}[-–]\d{4,}\s*$", "")), both)

    return bind(F.trim(F.get(F.split(clean(title), _SEGMENT, 2), F.lit(0))), stems)


def strip_echo(x: Column, title: Column, same=near_duplicate) -> Column:
    """A text without the title's words at its start: four words and twenty letters at least; what is left must be of some length.

    same(text, stem) says whether a text is the title again, in which case nothing is left.
    """
    return bind(title_stems(title), lambda stems: _without_stems(x, stems, same))


def _without_stems(x: Column, stems: Column, same=near_duplicate) -> Column:

    def stripped(text, stem):
        mine, theirs = (F.regexp_extract_all(v, F.lit(_TERM), F.lit(0)) for v in (text, stem))
        equal = F.zip_with(mine, theirs, lambda a, b: a.isNotNull() & b.isNotNull() & (key(a) == key(b)))

        def cut(e):
            at = F.array_position(e, F.lit(False)).cast("int")
            common = F.when(at > 0, at - 1).otherwise(F.size(e))
            size = F.aggregate(F.slice(theirs, F.lit(1), common), F.lit(0), lambda t, w: t + F.length(w))
            gaps = F.split(text, _TERM, -1)
            # what follows the last common word: its gap, then words and gaps in turn
            tail = F.array_join(F.transform(F.arrays_zip(gaps.alias("gap"), mine.alias("word")), lambda z, i: F.when(i < common, "").otherwise(F.concat(z["gap"], F.coalesce(z["word"], F.lit(""))))), "")
            left = F.regexp_replace(tail, r"^[ \t|:;,.!?\-–—]+", "")
            return F.when((common >= 4) & (size >= 20), F.when(F.length(left) >= 20, left).otherwise(""))

        again = (F.length(text) <= F.length(stem) + 45) & F.coalesce(same(text, stem), F.lit(False))
        return F.when(text == "", text).when(again, "").otherwise(bind(equal, cut))

    def first(text):
        one, two = F.get(stems, F.lit(0)), F.get(stems, F.lit(1))
        return F.coalesce(F.when(one.isNotNull(), stripped(text, one)), F.when(two.isNotNull(), stripped(text, two)), text)

    return bind(clean(x), first)


def summary_text(summary: Column, title: Column, acronyms: Sequence[str] = (), proper: Sequence[str] = (), limit: int = 360, rounds: int = 3) -> Column:
    """A summary in sentence case without echoes of the title or file numbers, cut to a limit, empty where only the title is left."""
    cased = lambda v: sentence_case(v, acronyms, proper) if acronyms or proper else collapse(v)
    once = lambda v, stems: cased(F.trim(F.regexp_replace(_without_stems(v, stems), r"^\s*\d{2,4}[-–]\d{4,}\s*(?:[|:;-]\s*)?", "")))

    def settled(v, stems, left):
        """v after so many rounds; one that changes nothing is the last."""
        return bind(once(v, stems), lambda new: F.when(new == v, new).otherwise(settled(new, stems, left - 1))) if left else v

    out = bind(title_stems(title), lambda stems: bind(cased(clean(summary)), lambda v: settled(v, stems, rounds)))
    return bind(out, lambda v: truncate(F.when(near_duplicate(v, title), "").otherwise(v), limit))


def holds_phrase(k: Column, phrases: Sequence[str]) -> Column:
    """Whether a key holds one of the phrases, which are spelled as it is."""
    import re

    keys = dict.fromkeys(re.sub("[^a-z0-9']+", " ", p.lower().replace("’", "'")).strip() for p in phrases)
    return F.exists(F.array(*[F.lit(v) for v in keys]), lambda v: F.contains(k, v)) if keys else F.lit(False)


def publisher_boilerplate(x: Column | str, source: Column | str, config) -> Column:
    """Whether a text is furniture by the rules of all publishers, or by its own publisher's phrases."""
    name = F.lower(blank(source))

    def owned(k: Column) -> Column:
        out = F.lit(False)
        for word, phrases in reversed(config.publisher_phrases):
            out = F.when(F.contains(name, F.lit(word)), holds_phrase(k, phrases)).otherwise(out)
        return out

    of = lambda c, k: _furniture(c, k, config.boilerplate_phrases, config.boilerplate_labels, config.boilerplate_prefixes) | owned(k)
    return bind(clean(x), lambda c: bind(apostrophe_key(c), lambda k: of(c, k)))


def boilerplate(x: Column | str, phrases: Sequence[str], labels: Sequence[str], prefixes: Sequence[str]) -> Column:
    """Whether a text is a publisher's furniture: empty, a phrase inside, a short label, or a module's short beginning."""
    return bind(clean(x), lambda c: bind(apostrophe_key(c), lambda k: _furniture(c, k, phrases, labels, prefixes)))


def _furniture(cleaned: Column, k: Column, phrases: Sequence[str], labels: Sequence[str], prefixes: Sequence[str]) -> Column:
    inside = holds_phrase(k, phrases)
    label = (F.length(cleaned) <= 90) & F.regexp_replace(F.lower(cleaned), "[.!]$", "").isin(*labels) if labels else F.lit(False)
    begins = (F.length(cleaned) <= 150) & F.exists(F.array(*[F.lit(v) for v in prefixes]), lambda v: F.startswith(k, v)) if prefixes else F.lit(False)
    return (k == "") | inside | label | begins


def scrub(x: Column | str, rule: tuple[str, str]) -> Column:
    """A text with a misleading name put out."""
    return F.regexp_replace(blank(x), f"(?i){rule[0]}", rule[1])


def strip_markdown(x: Column) -> Column:
    """Inline marks off: images go, links keep their words."""
    out = F.regexp_replace(x, r"!\[[^\]]*\]\([^)]*\)", "")
    out = F.regexp_replace(out, r"\[([^\]]+)\]\([^)]*\)", "$1")
    out = F.regexp_replace(out, r"(\*\*|__|\*|_|`)(\S(?:.*?\S)?)\1", "$2")
    return collapse(out)


def markdown_blocks(x: Column | str) -> Column:
    """Markdown as ordered blocks (type, text, level, items, url)."""
    chunks = F.filter(F.split(blank(x), r"\n\s*\n"), lambda c: F.trim(c) != "")
    none, items = F.lit(None).cast("string"), F.lit(None).cast("array<string>")

    def block(kind, text=none, level=F.lit(None).cast("int"), listed=items, url=none):
        return F.struct(F.lit(kind).alias("type"), text.alias("text"), level.alias("level"), listed.alias("items"), url.alias("url"))

    def one(c):
        c = F.trim(c)
        lines = F.filter(F.split(c, "\n"), lambda v: F.trim(v) != "")
        item = r"^\s*(?:[-*+]|\d+[.)])\s+"
        return (
            F.when(c.rlike(r"^#{1,6}\s"), block("heading", strip_markdown(F.regexp_replace(c, r"^#{1,6}\s+", "")), F.length(F.regexp_extract(c, "^(#+)", 1))))
            .when(F.forall(lines, lambda v: v.rlike(item)), block("list", listed=F.transform(lines, lambda v: strip_markdown(F.regexp_replace(v, item, "")))))
            .when(F.startswith(c, F.lit(">")), block("quote", strip_markdown(F.regexp_replace(c, r"(?m)^>\s?", ""))))
            .when(c.rlike(r"^!\[[^\]]*\]\([^)]+\)$"), block("image", F.regexp_extract(c, r"^!\[([^\]]*)\]", 1), url=F.regexp_extract(c, r"\(([^)\s]+)", 1)))
            .otherwise(block("paragraph", strip_markdown(c)))
        )

    return F.transform(chunks, one)


def author_tokens(author: Column | str, stopwords: Sequence[str], most: int = 6) -> Column:
    """The words of an author's name: without "by", without what follows a bar or the outlet, without roles; the first few."""
    name = F.regexp_replace(blank(author), r"(?i)^\s*by\s+", "")
    name = F.get(F.split(name, r"(?i)\s*[|·•]\s*|,\s*(?:cbc|ctv|global)\b", 2), F.lit(0))
    found = F.array_distinct(F.regexp_extract_all(F.lower(name), F.lit("([a-z0-9]+)"), F.lit(1)))
    stop = F.array(*[F.lit(v) for v in stopwords]) if stopwords else F.array().cast("array<string>")
    return F.slice(F.filter(F.array_except(found, stop), lambda t: F.length(t) >= 2), 1, most)


def author_mentioned(author: Column | str, x: Column | str, stopwords: Sequence[str] = (), least: int = 2) -> Column:
    """Whether a text holds so many of the words of an author's name, which has so many."""
    words = F.regexp_extract_all(F.lower(blank(x)), F.lit("([a-z0-9]+)"), F.lit(1))
    return bind(author_tokens(author, stopwords), lambda names: (F.size(names) >= least) & (F.size(F.array_intersect(names, words)) >= least))


def match_anchor(texts: Column, anchor: Column | str, share: float = 0.66) -> Column:
    """Place of the text that an anchor belongs to; null if none.

    The first text that is the anchor, holds it or stands in it; else the one that shares most of the words of the smaller
    of both, the first of equals, if that is enough.
    """
    words = lambda k: F.array_distinct(F.split(k, " "))

    def of(mine):
        def rate(t, i):
            k = key(t)
            within = (k != "") & (F.contains(k, mine) | F.contains(mine, k))
            overlap = F.size(F.array_intersect(words(k), words(mine))) / F.greatest(F.lit(1), F.least(F.size(words(k)), F.size(words(mine))))
            return F.struct(F.when(within, 2.0).when(k == "", 0.0).otherwise(overlap).alias("rate"), (-i).alias("i"))

        return F.when(mine != "", bind(F.array_max(F.transform(texts, rate)), lambda best: F.when(best["rate"] >= share, -best["i"])))

    return bind(key(anchor), of)
