"""Personal data by candidate gradient boosting, in DataFrame functions alone.

1. Base patterns per kind (email, ip, card, phone): leftmost non-overlapping matches that pass their check.
2. High-recall generators propose more spans, which may overlap: disguised addresses ("x [at] y [dot] z"), defanged and
   v6 IPs, cards with other separators, phone numbers without a country code.
3. Boosted trees score each proposal by format and context features; calibrated probabilities and a threshold per kind
   select. Of overlapping selections the likeliest stays; base spans always stay.

The trees are fitted once per process, on a bounded, generated sample of TRAIN_ROWS labelled spans that SQL makes, by the
same feature expressions that score the corpus.

Base patterns are written so that each is linear in the text: a match can't begin inside a run that a failed or earlier
attempt has ruled out, hence the look-behinds and possessive runs; what they match is the same.

Spans of a text are folded and compared in blocks of BLOCK neighbours, blocks by their stretches; what is around a span comes
from stretches of the text, cut in one pass. So the work grows as the spans, but for comparisons of pairs of blocks.

Defined results: null and empty texts have no spans; very long texts are read whole; a row is a document, also if ids
repeat; an empty table gives no rows; other columns are not read, but for base and spans, which find_pii replaces; places
count code points.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .boost import Boosted, cutoff, fit
from .common import apart, table

KINDS = ("email", "ip", "card", "phone")
TRAIN_ROWS = 4000
BLOCK, STRETCH = 64, 256
PRECISION = 0.98
_LOCAL = "[A-Za-z0-9._%+-]"
BASE = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"(?<![0-9])[0-9](?:[\x20-]?[0-9]){13,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text needs before a pattern is tried at all.
HINT = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]"}
PROPOSE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}\x20?(?:\[at\]|\(at\)|\{at\}|\x20at\x20)\x20?[A-Za-z0-9-]{1,63}(?:\x20?(?:\[dot\]|\(dot\)|\{dot\}|\x20dot\x20|\[\.\])\x20?[A-Za-z0-9-]{1,63}|\.[A-Za-z0-9-]{1,63}){1,8}",
    "ip": r"(?<![0-9A-Za-z:.])(?:[0-9]{1,3}(?:\x20?(?:\[\.\]|\(\.\)|\[dot\]|\(dot\))\x20?[0-9]{1,3}){3}|(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6})(?![0-9A-Za-z:])",
    "card": r"(?<![0-9])[0-9]{4}(?:[\x20._/-]{1,3}[0-9]{4}){2}[\x20._/-]{1,3}[0-9]{2,4}(?![0-9])|(?<![0-9])3[0-9]{3}[\x20._/-]{1,3}[0-9]{6}[\x20._/-]{1,3}[0-9]{5}(?![0-9])",
    "phone": r"(?<![0-9A-Za-z+.-])(?:00[0-9]{1,3}[\x20.-]?)?\(?[0-9]{2,4}\)?[\x20./-]{1,2}[0-9]{3,4}[\x20.-][0-9]{3,4}(?![0-9A-Za-z])",
}
PROPOSE_HINT = {"email": r"[\[({\x20]at[\])}\x20]\x20?[A-Za-z0-9-]{1,63}\x20?(?:[\[({.]|\x20dot\x20)", "ip": r"[\[(](?:\.|dot)[\])]|[0-9A-Fa-f]:[0-9A-Fa-f]{0,4}:", "card": r"[0-9]{4}[\x20._/-]", "phone": r"[0-9][)\x20./-]{1,3}[0-9]{3}"}
_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})"
SPAN = "array<struct<start:int,rank:int,kind:string,end:int,piece:string>>"


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    back = F.reverse(digits)
    doubled = F.transform(F.sequence(F.lit(1), F.greatest(F.length(back), F.lit(1))), lambda i: F.coalesce(F.try_to_number(F.substring(back, i, F.lit(1)), F.lit("9")).cast("int"), F.lit(0)) * (2 - i % 2))
    return F.aggregate(doubled, F.lit(0), lambda t, v: t + F.when(v > 9, v - 9).otherwise(v)) % 10 == 0


def _passes(kind: str, s: Column) -> Column:
    n = F.length(_digits(s))
    if kind == "ip":
        return s.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$")
    if kind == "card":
        return n.between(14, 19) & luhn(_digits(s))
    if kind == "phone":
        return n.between(10, 15)
    return F.lit(True)


def _bound(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _blocks(items: Column, size: int = BLOCK) -> Column:
    """An array (a column or bound: it is named for each run) cut into runs of size; an empty one has none."""
    starts = F.filter(F.sequence(F.lit(1), F.greatest(F.size(items), F.lit(1)), F.lit(size)), lambda i: i <= F.size(items))
    return F.transform(starts, lambda i: F.slice(items, i, F.lit(size)))


def find(text: Column, kind: str, pattern: str, hint: str) -> Column:
    """All matches of a pattern as spans in code points: pieces between matches and matches themselves sum up to places."""
    pieces = F.split(text, pattern, -1)
    both = F.arrays_zip(pieces.alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hit"))
    rank = KINDS.index(kind)
    length = lambda z: F.length(z["gap"]) + F.coalesce(F.length(z["hit"]), F.lit(0))

    def walk(at: Column, block: Column) -> Column:
        start = F.struct(at.alias("at"), F.array().cast(SPAN).alias("spans"))

        def step(acc, z):
            begin = acc["at"] + F.length(z["gap"])
            end = begin + F.length(z["hit"])
            span = F.struct(begin.alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), end.alias("end"), z["hit"].alias("piece"))
            return F.struct(F.coalesce(end, begin).alias("at"), F.when(z["hit"].isNull(), acc["spans"]).otherwise(F.concat(acc["spans"], F.array(span))).alias("spans"))

        return F.aggregate(block, start, step)["spans"]

    def placed(blocks: Column) -> Column:
        """The places where blocks begin first, then the spans of each."""
        sums = F.aggregate(blocks, F.array(F.lit(0)), lambda acc, block: F.concat(acc, F.array(F.aggregate(block, F.element_at(acc, -1), lambda t, z: t + length(z)))))
        return _bound(sums, lambda at: F.flatten(F.transform(blocks, lambda block, i: walk(F.get(at, i), block))))

    spans = _bound(both, lambda items: _bound(_blocks(items, 8 * BLOCK), placed))
    return F.when(text.rlike(hint), spans).otherwise(F.array().cast(SPAN))


def stretches(text: Column) -> Column:
    """A text cut into stretches of STRETCH code points, in one pass: what is around a place is found without a scan from the start."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{STRETCH}}}"), F.lit(0))


def _around(cut: Column, start: Column, n: Column) -> Column:
    """n code points (STRETCH at most) of a text cut into stretches, from a place counted from 0."""
    i = F.floor(start / STRETCH).cast("int")
    return F.substring(F.concat(F.coalesce(F.get(cut, i), F.lit("")), F.coalesce(F.get(cut, i + 1), F.lit(""))), start - i * STRETCH + 1, n)


def features(span: Column, cut: Column) -> list[Column]:
    """Format and context features of a proposed span, its text in stretches."""
    piece, kind = span["piece"], span["rank"]
    before = F.lower(_around(cut, F.greatest(span["start"] - 24, F.lit(0)), F.least(span["start"], F.lit(24))))
    after = _around(cut, span["end"], F.lit(2))
    digits = _digits(piece)
    flag = lambda c: c.cast("double")
    return [
        kind.cast("double"),
        F.length(digits).cast("double"),
        F.length(piece).cast("double"),
        flag(luhn(digits)),
        F.length(F.regexp_replace(piece, "[0-9A-Za-z]", "")).cast("double"),
        flag(before.rlike(r"tel|phone|call|mobile|fax|whatsapp|cell|sms|ring")),
        flag(before.rlike(r"mail|contact|write|reach")),
        flag(before.rlike(r"card|visa|master|amex|credit|paid|pay")),
        flag(before.rlike(r"\bip\b|host|server|address|login|client|from")),
        flag(before.rlike(r"version|order|invoice|isbn|ref|sku|build|date|\bid\b|no\.|#|part|serial|model|page|score")),
        flag(before.rlike(r"[0-9a-z]$")),
        flag(after.rlike(r"^[.:/-]?[0-9]")),
        flag(piece.rlike(r"[\[({]\x20?(?:at|dot|\.)")),
        flag(piece.rlike(r"^(?:19|20)[0-9]{2}[\x20./-]|^[0-9]{2}[./-][0-9]{3,4}[./-]")),
        flag(piece.rlike(r"^\(?[2-9]")),
        flag(piece.rlike(r"^[3-6]")),
        flag(piece.rlike(r"dot|\[\.\]")),
        flag(piece.rlike(r":[0-9A-Fa-f]{3,4}(?::|$)")),
        flag(piece.rlike(r"^[A-Za-z]*::[A-Za-z]*$")),
    ]


def proposals(text: Column) -> Column:
    return F.concat(*[find(text, k, PROPOSE[k], PROPOSE_HINT[k]) for k in KINDS])


def training_rows(spark: SparkSession, rows: int = TRAIN_ROWS) -> DataFrame:
    """text, label: generated spans of each kind and look-alikes, each in a made-up context; SQL makes them from row numbers."""
    h = lambda salt: f"abs(xxhash64(id, {salt}))"
    digit = lambda salt, n: f"lpad(cast({h(salt)} % {10**n} as string), {n}, '0')"
    pick = lambda salt, *xs: f"element_at(array({', '.join(repr(x) for x in xs)}), cast({h(salt)} % {len(xs)} + 1 as int))"
    body = f"concat('4', {digit(1, 3)}, {digit(2, 4)}, {digit(3, 4)}, {digit(4, 3)})"
    total = " + ".join(f"(case when {i} % 2 = 0 then (case when 2 * int(substr(c15, {i + 1}, 1)) > 9 then 2 * int(substr(c15, {i + 1}, 1)) - 9 else 2 * int(substr(c15, {i + 1}, 1)) end) else int(substr(c15, {i + 1}, 1)) end)" for i in range(15))
    sep = pick(9, ".", "_", "/", "  ")
    area = f"cast(200 + {h(5)} % 780 as string)"
    user = pick(6, "anna.k", "j.smith", "sales", "team42", "maria_b", "q.li")
    host = pick(7, "example", "mail3", "corp-x", "uni", "shop")
    octets = [f"cast({h(20 + i)} % 256 as string)" for i in range(4)]
    group = lambda salt: f"lower(hex(4096 + {h(salt)} % 61440))"
    dot = pick(8, "[.]", "(.)", "[dot]")
    base = spark.range(rows).selectExpr("id", "id % 4 as k", "(id div 4) % 2 as label", f"{body} as c15")
    base = base.selectExpr("*", f"concat(c15, cast(({total}) * 9 % 10 as string)) as good", f"concat(c15, cast((({total}) * 9 + 1 + {h(10)} % 8) % 10 as string)) as bad")
    card = lambda c: f"concat_ws({sep}, substr({c}, 1, 4), substr({c}, 5, 4), substr({c}, 9, 4), substr({c}, 13, 4))"
    span = f"""case
      when k = 0 and label = 1 then concat({user}, {pick(11, " [at] ", "(at)", " at ", "[at]")}, {host}, {pick(12, " [dot] ", "(dot)", " dot ", "[.]")}, {pick(13, "com", "org", "net", "fr")})
      when k = 0 then concat({pick(11, "look", "meet", "was", "stay", "open")}, ' at ', {pick(13, "home", "noon", "work", "school")}, {pick(14, " dot ", ".5", ".and")}, {pick(15, "then", "a", "so", "by")})
      when k = 1 and label = 1 and {h(40)} % 3 = 0 then concat_ws(':', {", ".join(group(50 + i) for i in range(8))})
      when k = 1 and label = 1 and {h(40)} % 3 = 1 then concat({group(50)}, ':', {group(51)}, {pick(41, "::", ":db8::", "::1:")}, {group(52)})
      when k = 1 and label = 1 then concat_ws({dot}, {", ".join(octets)})
      when k = 1 and {h(40)} % 4 = 0 then concat({pick(11, "face", "add", "a", "be")}, '::', {pick(12, "bad", "dead", "fade", "c")})
      when k = 1 then concat({pick(11, "12:", "07:", "1a:", "aa:")}, {digit(12, 2)}, ':', {digit(13, 2)}, ':', {digit(14, 2)}, ':', {digit(15, 2)}, ':', {digit(16, 2)}, ':', {digit(17, 2)}, ':', {digit(18, 2)})
      when k = 2 and label = 1 then {card("good")}
      when k = 2 then {card("bad")}
      when k = 3 and label = 1 then concat({pick(11, "(", "")}, {area}, {pick(12, ") ", "-", ".", " ")}, {digit(13, 3)}, {pick(14, "-", ".", " ")}, {digit(15, 4)})
      else concat({pick(11, "2019", "2024", "12", "31", "1998", "01")}, {pick(12, "-", ".", "/", " ")}, {digit(13, 3)}, {pick(14, "-", ".", " ")}, {digit(15, 3)}) end"""
    cue = f"""case when label = 1 and {h(30)} % 3 > 0 then element_at(array('mail me: ', 'client ip ', 'my card ', 'call me on '), int(k + 1))
      when label = 0 and {h(30)} % 3 > 0 then {pick(31, "order no. ", "version ", "part ", "ref ", "isbn ", "they ", "page ")} else {pick(32, "and ", "the ", "so, ", "")} end"""
    return base.selectExpr("id", "k", "label", f"concat({pick(33, 'Well, ', 'ndly er. ', '')}, {cue}, {span}, {pick(34, ' and then.', '.', ' erly on', '')}) as text")


_fitted: dict[str, tuple[Boosted, tuple[float, ...]]] = {}


def model(spark: SparkSession) -> tuple[Boosted, tuple[float, ...]]:
    """The trees and a threshold for each kind; fitted once per process, always on the same rows."""
    if "model" not in _fitted:
        rows = training_rows(spark).withColumn("span", F.explode(proposals(F.col("text")))).where("span.rank = k").orderBy("id", "span.start")
        got = rows.select("label", F.array(*features(F.col("span"), stretches(F.col("text")))).alias("x")).collect()
        x, y = np.array([r["x"] for r in got]), np.array([r["label"] for r in got])
        trees = fit(x, y)
        held = np.arange(len(y)) % 5 == 3  # rows that neither the trees nor their calibration have seen
        p = 1 / (1 + np.exp(-(trees.slope * trees.raw(x) + trees.shift)))
        _fitted["model"] = trees, tuple(cutoff(p[held & (x[:, 0] == k)], y[held & (x[:, 0] == k)], PRECISION) for k in range(len(KINDS)))
    return _fitted["model"]


def _meet(a: Column, b: Column) -> Column:
    return (a["start"] < b["end"]) & (b["start"] < a["end"])


def _base(text: Column, kind: str) -> Column:
    return F.filter(find(text, kind, BASE[kind], HINT[kind]), lambda s: _passes(kind, s["piece"]))


def _clear(items: Column, others: Column, hit) -> Column:
    """The items that no other hits, both in order of start: a block of neighbours looks only into the blocks of others that meet its stretch."""
    stretch = lambda block: (F.array_min(F.transform(block, lambda s: s["start"])).alias("start"), F.array_max(F.transform(block, lambda s: s["end"])).alias("end"))
    near = lambda grouped, on: F.flatten(F.transform(F.filter(grouped, lambda g: _meet(g, on)), lambda g: F.filter(g["items"], lambda o: _meet(o, on))))
    left = lambda block, found: F.filter(block, lambda s: ~F.exists(found, lambda o: hit(s, o)))
    one = lambda grouped: lambda block: _bound(F.struct(*stretch(block)), lambda on: _bound(near(grouped, on), lambda found: left(block, found)))
    grouped_ = F.transform(_blocks(others), lambda b: F.struct(*stretch(b), b.alias("items")))
    return _bound(grouped_, lambda grouped: F.flatten(F.transform(_blocks(items), one(grouped))))


def find_pii(docs: DataFrame) -> DataFrame:
    """docs with base and spans: arrays of (start, rank, kind, end, piece), sorted by start, then kind."""
    trees, cuts = model(docs.sparkSession)
    docs = docs.drop("base", "spans")
    text, more, scored, cut = apart(docs, "whole", "more", "scored", "cut")
    out = docs.withColumn(text, F.coalesce(F.col("text"), F.lit("")))
    base = F.concat(*[_base(F.col(text), k) for k in KINDS])
    out = out.withColumn("base", F.array_sort(base)).withColumn(more, F.array_sort(proposals(F.col(text))))
    out = out.withColumn(more, F.when(F.size(more) > 0, _clear(F.col(more), F.col("base"), _meet)))
    out = out.withColumn(cut, F.when(F.size(more) > 0, stretches(F.col(text))))
    level = lambda s: reduce(lambda c, k: c.when(s["rank"] == k, F.lit(cuts[k])), range(1, len(KINDS)), F.when(s["rank"] == 0, F.lit(cuts[0])))
    likely = F.transform(more, lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end"), trees.score(features(s, F.col(cut))).alias("p"), s.alias("span")))
    out = out.withColumn(scored, F.when(F.size(more) > 0, F.filter(likely, lambda z: z["p"] >= level(z))))
    beats = lambda z, o: _meet(o, z) & ((o["p"] > z["p"]) | ((o["p"] == z["p"]) & (F.struct(o["start"], o["rank"]) < F.struct(z["start"], z["rank"]))))
    stays = F.when(F.size(scored) > 0, _clear(F.col(scored), F.col(scored), beats))
    added = F.coalesce(F.transform(stays, lambda z: z["span"]), F.array().cast(SPAN))
    return out.withColumn("spans", F.array_sort(F.concat("base", added))).drop(text, more, scored, cut)


def redact(docs: DataFrame) -> DataFrame:
    """docs with every span of find_pii replaced by its kind in brackets; overlapping spans become one mark."""
    found = find_pii(docs)
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("text"))
    text = F.coalesce(F.col("text"), F.lit(""))
    walk = F.aggregate("spans", start, lambda acc, s: F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(s["start"] >= acc["at"], F.concat(acc["text"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit("["), s["kind"], F.lit("]"))).otherwise(acc["text"]).alias("text")))
    return found.withColumn("__walk", walk).withColumn("redacted", F.concat(F.col("__walk.text"), F.expr("substring(coalesce(text, ''), __walk.at + 1)"))).drop("__walk")


def digests(found: DataFrame) -> DataFrame:
    joined = lambda c: F.concat_ws(",", F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    counts = [count(k) for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op3: personal data of every document."""
    return digests(find_pii(table(spark, sf_dir, "documents").select("doc_id", "text")))
