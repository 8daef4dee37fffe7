"""A Merkle manifest of a table: a digest for each row, each source and the whole, and a proof for each row.

Leaves are ranged by source, id and digest, so that a partition holds a run of neighbouring leaves; every leaf knows its
place and how many its source has. A fragment is a sparse forest: nodes keyed by scope (a source's number, or TOP), level
and index. Two fragments merge by union, and wherever all siblings of a run, whose number the count of leaves tells, have
come together, their parent takes their place: an associative, commutative operation with the empty forest as its zero.
Each partition reduces its own leaves to such a fragment, of some dozen nodes a level at its two ends; tiers of tasks merge
FAN neighbouring fragments each, until one node, the root, is left. This is a tree reduction whose tiers are written tables:
Spark's own ends on the driver and forgets what it has merged, and proofs need those nodes.

A second pass gives every partition the nodes outside it that its proofs name (at most FANOUT for each level and end), and
rebuilds its own from its leaves, so nothing grows with a source but the number of its partitions.

Defined results: null fields stand as "-" in a leaf, so a null and an empty text differ; a null source is a source of its
own and the first; null ids come first; rows that share source and id follow each other by digest, and equal rows are
leaves of their own, alike whatever their order; a text is hashed whole, however long; an empty table has no rows, no source
and no root; a lone leaf is its source's subroot, and a lone source's subroot the root; other columns are not read,
whatever their names. A row is tampered only where it has an id.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import durable, forget, table, width

#: Children of a node, and fragments that a task merges.
FANOUT, FAN = 16, 8
BITS = FANOUT.bit_length() - 1
#: The scope over the sources.
TOP = -1
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_NODE = "pid long, scope long, level int, index long, hash string, n long, open boolean, made boolean"


def leaf(fields: list[Column]) -> Column:
    """Digest of the fields: of each its length in bytes and its value, or "-" where it is null."""
    one = lambda c: F.coalesce(F.concat(F.octet_length(c.cast("string")), F.lit(":"), c.cast("string")), F.lit("-"))
    return F.sha2(F.concat(*[one(c) for c in fields]), 256)


def lowered(x: Column) -> Column:
    return F.translate(x, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def digest(parts) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def parents(n: int) -> int:
    return -(-n // FANOUT)


def grow(first: int, nodes: list[str], n: int) -> list[tuple[int, list[str]]]:
    """What neighbouring nodes (from index first, of n on their level) make: for each level the first index and the nodes."""
    levels = [(first, nodes)]
    while n > 1 and nodes:
        end = first + len(nodes)
        r0, r1 = parents(first), parents(n) if end == n else end // FANOUT
        nodes = [digest(nodes[max(0, r * FANOUT - first) : (r + 1) * FANOUT - first]) for r in range(r0, r1)]
        first, n = r0, parents(n)
        levels.append((first, nodes))
    return levels


def unresolved(levels: list[tuple[int, list[str]]], n: int) -> Iterator[tuple[int, int, str]]:
    """Level, index and hash of the nodes whose parent isn't made."""
    for level, (first, nodes) in enumerate(levels):
        above, made = levels[level + 1] if level + 1 < len(levels) else (0, [])
        for i, h in enumerate(nodes, first):
            if n == 1 or not above <= i // FANOUT < above + len(made):
                yield level, i, h
        n = parents(n)


def merge(rows: list[tuple[int, int, int, str, int]], sources: int) -> tuple[list, list]:
    """Nodes (scope, level, index, hash, count of the level's nodes) of several fragments -> what stays open, and what was made."""
    runs: dict[tuple, dict[int, str]] = {}
    made, closed = [], set()
    todo = list(rows)
    while todo:
        scope, level, i, h, n = todo.pop()
        if n == 1 and scope != TOP:
            made.append((TOP, 0, scope, h, sources))
            closed.add((scope, level, i))
            todo.append(made[-1])
            continue
        if n == 1:
            continue
        run = runs.setdefault((scope, level, i // FANOUT), {})
        run[i] = h
        if len(run) == min(FANOUT, n - i // FANOUT * FANOUT):
            made.append((scope, level + 1, i // FANOUT, digest(run[j] for j in sorted(run)), parents(n)))
            closed.update((scope, level, j) for j in run)
            todo.append(made[-1])
    return [x for x in (*rows, *made) if x[:3] not in closed], made


def _table(rows: list[tuple], pid: int) -> pa.Table:
    types = (pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.bool_(), pa.bool_())
    names = ("scope", "level", "index", "hash", "n", "open", "made")
    columns = list(zip(*rows)) if rows else [()] * len(names)
    return pa.table({"pid": pa.array([pid] * len(rows), pa.int64()), **{k: pa.array(c, t) for k, c, t in zip(names, columns, types)}})


def _chunks(leaves: pa.Table, notes: pa.Table) -> tuple[pa.Table, list[dict]]:
    """A partition's leaves in order, and where its sources lie in them."""
    leaves = leaves.sort_by("at")
    chunks, at = sorted(notes.filter(pc.equal(notes["level"], -1)).to_pylist(), key=lambda c: c["scope"]), 0
    for c in chunks:
        c["from"], at = at, at + c["m"]
    return leaves, chunks


def _fragment(sources: int):
    def run(leaves: pa.Table, notes: pa.Table) -> pa.Table:
        leaves, chunks = _chunks(leaves, notes)
        rows, roots = [], {}
        for c in chunks:
            own = [h.hex() for h in leaves["leaf"].slice(c["from"], c["m"]).to_pylist()]
            levels = grow(c["index"], own, c["n"])
            if c["m"] == c["n"]:
                roots[c["scope"]] = levels[-1][1][0]
                continue
            n = [c["n"]]
            while n[-1] > 1:
                n.append(parents(n[-1]))
            rows += [(c["scope"], level, i, h, n[level], True, False) for level, i, h in unresolved(levels, c["n"])]
        if roots:
            # the sources that lie here whole are neighbours
            levels, n = grow(min(roots), [roots[i] for i in sorted(roots)], sources), sources
            still = {(level, i) for level, i, _ in unresolved(levels, sources)}
            for level, (first, nodes) in enumerate(levels):
                rows += [(TOP, level, i, h, n, (level, i) in still, False) for i, h in enumerate(nodes, first) if level == 0 or (level, i) in still]
                n = parents(n)
        return _table(rows, leaves["pid"][0].as_py())

    return run


def _merged(sources: int):
    def run(t: pa.Table) -> pa.Table:
        rows = list(zip(*[t[c].to_pylist() for c in ("scope", "level", "index", "hash", "n")]))
        still, made = merge(rows, sources)
        open_, new = {x[:3] for x in still}, {x[:3] for x in made}
        return _table([(*x, x[:3] in open_, x[:3] in new) for x in {*still, *made}], t["pid"][0].as_py())

    return run


class Paths:
    """Siblings of nodes on their way up, from a partition's own nodes and those it was given."""

    def __init__(self, scopes: dict[int, tuple[list, int]], given: dict[tuple, str]):
        self.scopes, self.given, self.known = scopes, given, {}

    def node(self, scope: int, level: int, i: int) -> str:
        levels = self.scopes[scope][0]
        if level < len(levels) and 0 <= i - levels[level][0] < len(levels[level][1]):
            return levels[level][1][i - levels[level][0]]
        return self.given[scope, level, i]

    def run(self, scope: int, level: int, r: int, n: int) -> list[str]:
        if (scope, level, r) not in self.known:
            self.known[scope, level, r] = [self.node(scope, level, i) for i in range(r * FANOUT, min(n, (r + 1) * FANOUT))]
        return self.known[scope, level, r]

    def up(self, scope: int, level: int, i: int, n: int) -> tuple[list[tuple[str, str]], str]:
        """Left and right siblings, joined, from this node to the root, and all of them in one string."""
        if n == 1:
            return ([], "") if scope == TOP else self.cached(TOP, 0, scope, self.scopes[TOP][1])
        run, k = self.run(scope, level, i // FANOUT, n), i % FANOUT
        pair = "".join(run[:k]), "".join(run[k + 1 :])
        steps, rest = self.cached(scope, level + 1, i // FANOUT, parents(n))
        return [pair, *steps], "".join((*pair, rest))

    def cached(self, *node: int) -> tuple[list[tuple[str, str]], str]:
        if (0, *node) not in self.known:
            self.known[0, *node] = self.up(*node)
        return self.known[0, *node]


def fold(node: str, steps: list[tuple[str, str]]) -> str:
    """The root that a leaf's digest and its siblings lead to; a run of one has two empty strings."""
    for left, right in steps:
        node = digest((left, node, right))
    return node


_PROOF = "doc_id long, leaf string, subroot string, root string, proof array<struct<left:string,right:string>>, proof_sha256 string, folded_root string, verified boolean"


def _proved(sources: int, siblings: bool):
    def run(leaves: pa.Table, notes: pa.Table) -> pa.Table:
        leaves, chunks = _chunks(leaves, notes)
        outer = notes.filter(pc.greater(notes["level"], -1))
        given = dict(zip(zip(*[outer[c].to_pylist() for c in ("scope", "level", "index")]), outer["hash"].to_pylist()))
        scopes, roots = {}, {}
        hexes = [h.hex() for h in leaves["leaf"].to_pylist()]
        for c in chunks:
            scopes[c["scope"]] = grow(c["index"], hexes[c["from"] : c["from"] + c["m"]], c["n"]), c["n"]
            if c["m"] == c["n"]:
                roots[c["scope"]] = scopes[c["scope"]][0][-1][1][0]
        scopes[TOP] = grow(min(roots, default=0), [roots[i] for i in sorted(roots)], sources), sources
        paths, tops, n = Paths(scopes, given), 0, sources
        while n > 1:
            tops, n = tops + 1, parents(n)
        root = paths.node(TOP, tops, 0)
        out = {k: [] for k in ("leaf", "subroot", "root", "proof", "proof_sha256", "folded_root", "verified")}
        tampered = leaves["tampered"].to_pylist()
        for c in chunks:
            subroot = paths.node(TOP, 0, c["scope"])
            for k in range(c["from"], c["from"] + c["m"]):
                steps, text = paths.up(c["scope"], 0, c["index"] + k - c["from"], c["n"])
                found = fold(tampered[k].hex() if tampered[k] is not None else hexes[k], steps)
                row = (hexes[k], subroot, root, [{"left": a, "right": b} for a, b in steps] if siblings else None, digest((text,)), found, found == root)
                for name, v in zip(out, row):
                    out[name].append(v)
        pair = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))
        types = {"proof": pair, "verified": pa.bool_()}
        return pa.table({"doc_id": leaves["doc_id"], **{k: pa.array(v, types.get(k, pa.string())) for k, v in out.items()}})

    return run


@dataclass
class Manifest:
    """leaves(pid, at, s, doc_id, leaf, tampered) in order, sources(s, scope, n), chunks of both, and the nodes that fragments met with."""

    leaves: DataFrame
    sources: DataFrame
    chunks: DataFrame
    nodes: DataFrame
    n_sources: int

    def roots(self) -> DataFrame:
        """source, n_leaves, subroot, root: a row for each source."""
        depth, n = 0, self.n_sources
        while n > 1:
            depth, n = depth + 1, parents(n)
        subroots = self.nodes.where((F.col("scope") == TOP) & (F.col("level") == 0)).select(F.col("index").alias("scope"), F.col("hash").alias("subroot")).distinct()
        root = self.nodes.where((F.col("scope") == TOP) & (F.col("level") == depth) & (F.col("index") == 0)).agg(F.first("hash").alias("root"))
        source = F.when(F.col("s") != "", F.substring("s", 2, 1 << 30)).alias("source")
        return self.sources.join(subroots, "scope").join(F.broadcast(root)).select(source, F.col("n").alias("n_leaves"), "subroot", "root")

    def proofs(self, siblings: bool = True) -> DataFrame:
        """A row for each leaf: doc_id, leaf, subroot, root, proof (null without siblings), its digest, and the root that its tampered digest, or else its own, folds to."""
        shift = lambda x, level: F.floor(x / F.pow(F.lit(float(FANOUT)), level)).cast("long")
        levels = lambda n: F.filter(F.sequence(F.lit(0), F.lit(15)), lambda k: F.pow(F.lit(float(FANOUT)), k) < n)
        runs = lambda scope, a, b, n: F.flatten(F.transform(levels(n), lambda k: F.transform(F.array_distinct(F.array(shift(a, k + 1), shift(b, k + 1))), lambda r: F.struct(scope.cast("long").alias("scope"), k.cast("int").alias("level"), r.alias("run")))))
        c = F.col
        cut = self.chunks.where("m < n").select("pid", F.explode(runs(c("scope"), c("index"), c("index") + c("m") - 1, c("n"))).alias("x"))
        ends = self.chunks.groupBy("pid").agg(F.min("scope").alias("a"), F.max("scope").alias("b"))
        s = F.lit(self.n_sources)
        peak = F.array(F.struct(F.lit(TOP).cast("long").alias("scope"), F.size(levels(s)).alias("level"), F.lit(0).cast("long").alias("run")))
        over = ends.select("pid", F.explode(F.concat(runs(F.lit(TOP), c("a"), c("b"), s), peak)).alias("x"))
        needs = cut.unionByName(over).select("pid", "x.*").distinct()
        nodes = self.nodes.select("scope", "level", F.floor(c("index") / FANOUT).alias("run"), "index", "hash").distinct()
        none = F.lit(None).cast("long")
        outer = needs.join(nodes, ["scope", "level", "run"]).select("pid", "scope", "level", "index", "hash", none.alias("m"), none.alias("n"))
        notes = self.chunks.select("pid", "scope", F.lit(-1).alias("level"), "index", F.lit(None).cast("string").alias("hash"), "m", "n").unionByName(outer)
        return self.leaves.groupBy("pid").cogroup(notes.groupBy("pid")).applyInArrow(_proved(self.n_sources, siblings), _PROOF)


def build(docs: DataFrame, fields: tuple[str, ...] = FIELDS, tamper: Column | None = None) -> Manifest:
    """The manifest of docs, over the fields named (doc_id, source and text among them). tamper: a condition on rows whose text is taken lower-cased when proofs are folded."""
    spark = docs.sparkSession
    c = F.col
    digests = [leaf([c(f) for f in fields]), leaf([lowered(c(f)) if f == "text" else c(f) for f in fields])]
    some = F.lit(False) if tamper is None else F.coalesce(tamper, F.lit(False))
    key = F.coalesce(F.concat(F.lit("="), c("source").cast("string")), F.lit(""))
    rows = docs.select(*fields).select(key.alias("s"), c("doc_id").cast("long").alias("doc_id"), F.unhex(digests[0]).alias("leaf"), F.when(some, F.unhex(digests[1])).alias("tampered"))
    # equal rows have nothing else to be dealt by
    order = ["s", "doc_id", "leaf", "salt"]
    rows = rows.withColumn("salt", F.monotonically_increasing_id()).repartitionByRange(width(spark), *order).sortWithinPartitions(*order)
    rows = rows.drop("salt").withColumn("at", F.monotonically_increasing_id()).withColumn("pid", F.shiftright("at", 33))
    leaves = durable(rows, "leaves")
    parts = durable(leaves.groupBy("pid", "s").agg(F.count("*").alias("m")), "parts")
    sources = parts.groupBy("s").agg(F.sum("m").alias("n"), F.min("pid").alias("p"))
    # numbers of sources: those of a partition by name, after those that begin in partitions before it
    before = sources.groupBy("p").agg(F.count("*").alias("k")).select("p", (F.sum("k").over(Window.orderBy("p")) - F.col("k")).alias("before"))
    numbered = sources.join(before, "p").select("s", "n", (F.col("before") + F.row_number().over(Window.partitionBy("p").orderBy("s")) - 1).alias("scope"))
    sources = durable(numbered, "sources")
    chunks = parts.withColumn("index", F.sum("m").over(Window.partitionBy("s").orderBy("pid")) - F.col("m")).join(sources, "s")
    chunks = durable(chunks.select("pid", "scope", "index", "m", "n"), "chunks")
    forget(parts)
    n, last = chunks.agg(F.max("scope"), F.max("pid")).first()
    n, last = (n or 0) + 1, last or 0
    notes = chunks.withColumn("level", F.lit(-1))
    tier = durable(leaves.select("pid", "at", "leaf").groupBy("pid").cogroup(notes.groupBy("pid")).applyInArrow(_fragment(n), _NODE), "fragments")
    nodes = tier
    while last:
        tier = durable(tier.where("open").withColumn("pid", F.floor(F.col("pid") / FAN)).groupBy("pid").applyInArrow(_merged(n), _NODE), "fragments")
        nodes = nodes.unionByName(tier.where("made"))
        last //= FAN
    return Manifest(leaves, sources, chunks, nodes, n)


def every_fifth(doc_id: Column) -> Column:
    """Rows whose number's crc32 5 divides."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op12: digests and proofs of all documents."""
    docs = table(spark, sf_dir, "documents")
    return build(docs, tamper=every_fifth(F.col("doc_id"))).proofs(siblings=False).drop("proof")


def _oracle(levels: int = 6) -> str:
    """DuckDB SQL: a level after the other, for sources of up to 16**levels rows and as many sources."""
    field = lambda x: f"coalesce(octet_length(encode(CAST({x} AS VARCHAR))) || ':' || {x}, '-')"
    leaf_ = lambda text: "sha256(" + " || ".join(field(x) for x in ("doc_id", "source", "lang", "n_chars", text)) + ")"
    low = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    out = [f"d AS (SELECT doc_id, source, {leaf_('text')} AS leaf, {leaf_(low)} AS other FROM documents)"]
    out.append("bits AS (SELECT list_transform(range(256), lambda b: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, b)) AS t)")
    code = "list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))"
    out.append(f"crc AS (SELECT doc_id, xor(list_reduce({code}, lambda c, b: xor(t[1 + (xor(c, b) & 255)], c >> 8), 4294967295), 4294967295) AS crc FROM (SELECT DISTINCT doc_id FROM d), bits)")
    out.append("a0 AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i0 FROM d)")
    out.append("s0 AS (SELECT source, i0 AS i, leaf AS h, count(*) OVER (PARTITION BY source) AS n FROM a0)")

    def rise(x: str, scope: str) -> None:
        for k in range(levels):
            by = f"{scope}, " if scope else ""
            over = f"PARTITION BY {scope}" if scope else ""
            out.append(f"{x}r{k} AS (SELECT {by}i // 16 AS r, any_value(n) AS n, list(h ORDER BY i) AS hs FROM {x}{k} GROUP BY {by}i // 16)")
            out.append(f"{x}{k + 1} AS (SELECT *, count(*) OVER ({over}) AS n FROM (SELECT {by}r AS i, CASE WHEN n > 1 THEN sha256(array_to_string(hs, '')) ELSE hs[1] END AS h FROM {x}r{k}))")

    rise("s", "source")
    out.append(f"t0 AS (SELECT row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS i, h, count(*) OVER () AS n FROM s{levels})")
    out.append(f"names AS (SELECT source, h AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS j FROM s{levels})")
    rise("t", "")
    out.append("p0 AS (SELECT a0.*, names.subroot, names.j, coalesce(crc.crc % 5 = 0, false) AS bad, CASE WHEN coalesce(crc.crc % 5 = 0, false) THEN other ELSE leaf END AS f, '' AS proof FROM a0 JOIN names ON names.source IS NOT DISTINCT FROM a0.source LEFT JOIN crc ON crc.doc_id = a0.doc_id)")
    step = 0
    for x, place in (("s", "i0"), ("t", "j")):
        for k in range(levels):
            at = f"(p.{place} // {16**k})"
            on = f"r.source IS NOT DISTINCT FROM p.source AND r.r = {at} // 16" if x == "s" else f"r.r = {at} // 16"
            left, right = f"array_to_string(hs[1:{at} % 16], '')", f"array_to_string(hs[{at} % 16 + 2:], '')"
            out.append(f"p{step + 1} AS (SELECT p.* REPLACE (CASE WHEN n > 1 THEN sha256({left} || f || {right}) ELSE f END AS f, CASE WHEN n > 1 THEN proof || {left} || {right} ELSE proof END AS proof) FROM p{step} p JOIN {x}r{k} r ON {on})")
            step += 1
    return f"WITH {', '.join(out)} SELECT doc_id, leaf, subroot, h AS root, sha256(proof) AS proof_sha256, f AS folded_root, f = h AS verified FROM p{step} CROSS JOIN (SELECT h FROM t{levels})"


ORACLE = _oracle()
