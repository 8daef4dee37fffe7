"""Byte-level BPE encoding and decoding: higher-order functions fold ranked merges over the bytes of distinct words.

1. code      Texts are cut into words by the tokenizer's pattern. Each task numbers the different words of its documents, in
             chunks of at most CHUNK_WORDS of them; a document becomes a row of these numbers, a chunk a list of words.
2. gather    The lists meet by word: each distinct word of the corpus stands once, with its occurrences (chunk, number).
3. fold      A word's bytes are a row of ids that merge pair by pair, least rank first, leftmost on ties: a fold of Spark's
             higher-order functions. The rank map is one value: pairs of ids sit in one flat array by cuckoo hashing, so a
             look-up reads two places.
4. deal      Each word's ids go back to its chunks, and a chunk's documents take the ids of their words.

Decoding takes each id's bytes from a literal array and concatenates them.

The fold looks at all pairs of a word in each round, so its work grows with the square of the word's length. Words of more
than FOLD_BYTES bytes are merged by the same ranks with a heap instead, so that one word of a megabyte is no burden.

Defined results: a null text is empty and has no ids; rows are encoded one by one, so repeated rows and ids don't matter;
very long texts and words are encoded whole; an empty table gives no rows; other columns stay as they are, whatever their
names (but for one named ids, which is replaced).
"""

from __future__ import annotations

import base64
import heapq
import json
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import public_tokenizers
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import durable, durable_parts, flat, forget, inside, lean, lean_group, narrow, settle, table, width

#: Different words of a chunk, at most (and those of one more batch); occurrences of a word that travel in one row.
CHUNK_WORDS, TOGETHER = 1 << 19, 1 << 12
#: Longer words are merged with a heap.
FOLD_BYTES = 256
BITS = 17
_MASK, _NONE = (1 << BITS) - 1, 1 << BITS
_A, _B = (40503, 30011), 52711


def pattern(python: str) -> str:
    """A tokenizer's pattern for Java: classes of the whole of Unicode."""
    return "(?U)" + python


@lru_cache(4)
def ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def merge(ids: list[int], pairs: dict[int, int]) -> list[int]:
    """The merges of one row of ids outside Spark's expressions; pairs has merged ids by a << BITS | b.

    A heap has the pairs by rank and place; entries whose pair is no more are passed over when they come up.
    """
    n = len(ids)
    ids, after, before = list(ids), list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := pairs.get(ids[i] << BITS | ids[i + 1])) is not None]
    heapq.heapify(heap)
    while heap:
        r, i, a, b = heapq.heappop(heap)
        j = after[i]
        if ids[i] != a or j >= n or ids[j] != b:
            continue
        ids[i], ids[j], after[i] = r, -1, after[j]
        if after[i] < n:
            before[after[i]] = i
        for x, y in ((before[i], i), (i, after[i])):
            if x >= 0 and y < n and (rank := pairs.get(ids[x] << BITS | ids[y])) is not None:
                heapq.heappush(heap, (rank, x, ids[x], ids[y]))
    return [x for x in ids if x >= 0]


@lru_cache(4)
def pair_ids(path: str) -> dict[int, int]:
    """Merged ids of all pairs of tokens that make a token."""
    table_ = ranks(path)
    return {table_[t[:i]] << BITS | table_[t[i:]]: r for t, r in table_.items() for i in range(1, len(t)) if t[:i] in table_ and t[i:] in table_}


@lru_cache(4)
def byte_ids(path: str) -> list[int]:
    return [ranks(path)[bytes([i])] for i in range(256)]


def _places(a: int, b: int, size: int) -> tuple[int, int]:
    """The two places of a pair of ids in a table of 2**n places."""
    return a * _A[0] + b & size - 1, a * _A[1] + b * _B >> 3 & size - 1


@lru_cache(4)
def pair_table(path: str) -> list[int]:
    """Cuckoo table of (a << 34 | b << 17 | merged id), -1 where empty, over all pairs of tokens that make a token."""
    pairs = pair_ids(path)
    size = 1 << max(8, len(pairs).bit_length() + 1)
    while True:
        out, ok = [-1] * size, True
        for pair, r in pairs.items():
            entry = pair << BITS | r
            at = _places(pair >> BITS, pair & _MASK, size)[0]
            for _ in range(500):
                out[at], entry = entry, out[at]
                if entry < 0:
                    break
                one, two = _places(entry >> 2 * BITS, entry >> BITS & _MASK, size)
                at = two if at == one else one
            else:
                ok = False
                break
        if ok:
            return out
        size *= 2


@lru_cache(4)
def odd_tokens(path: str) -> dict[bytes, int]:
    """Tokens that merges don't reach; as words they are their own id all the same."""
    first, pairs = byte_ids(path), pair_ids(path)
    return {t: r for t, r in ranks(path).items() if merge([first[x] for x in t], pairs) != [r]}


def _long(v: int) -> Column:
    return F.lit(v).cast("long")


class Bpe:
    """Expressions of one vocabulary.

    With spark, the tables are columns that with_tables() adds, scalar subqueries on a written row: as a literal, the pairs stand in
    the text of a plan, which the driver makes and keeps several times a query, two megabytes each, and are objects one by one.
    """

    def __init__(self, path: str, python_pattern: str = public_tokenizers.PATTERN, spark: SparkSession | None = None):
        self.path, self.pattern = path, pattern(python_pattern)
        table_ = pair_table(path)
        self.size = len(table_)
        if spark is None:
            self.pairs = F.from_json(F.lit(json.dumps(table_, separators=(",", ":"))), "array<bigint>")
            self.bytes = F.from_json(F.lit(json.dumps(byte_ids(path))), "array<bigint>")
            return
        kinds = pa.schema([(name, pa.list_(pa.int64())) for name in ("pairs", "bytes")])
        self.row = durable(spark.createDataFrame(pa.table({"pairs": [table_], "bytes": [byte_ids(path)]}, schema=kinds)), "merges")
        self.pairs, self.bytes = F.col("pairs"), F.col("bytes")

    def with_tables(self, words: DataFrame) -> DataFrame:
        """words with the columns pairs and bytes, for one use of word_ids() in the next projection: the optimizer makes one of both, so that no row carries the tables."""
        return words.select("*", *[self.row.select(name).scalar().alias(name) for name in ("pairs", "bytes")])

    def linked(self, pairs: Column, a: Column, b: Column) -> Column:
        """(id that a and b merge into) << BITS | a; _NONE stands for no such id. b may be _NONE."""
        places = (a * _long(_A[0]) + b), F.shiftright(a * _long(_A[1]) + b * _long(_B), 3)
        key = F.shiftleft(F.shiftleft(a, BITS).bitwiseOR(b), BITS)
        # an entry is the pair and its id: what differs from the pair in the low bits alone is the id
        found = [F.get(pairs, p.bitwiseAND(_long(self.size - 1)).cast("int")).bitwiseXOR(key).bitwiseAND(_long((1 << 62) - 1)) for p in places]
        return F.shiftleft(F.least(*found, _long(_NONE)), BITS).bitwiseOR(a)

    def word_ids(self, word: Column) -> Column:
        """Ids of one word: a fold of ranked merges over its bytes.

        The row under way holds each id with the rank of the pair that it starts, so a round finds the least rank and its
        leftmost place, puts the merged id there, and looks up only the two pairs that are new.
        """
        # the literals stand at the top, once: inside the lambdas, every level of a plan's text would spell them out again
        known = F.struct(self.pairs.alias("pairs"), self.bytes.alias("bytes"))
        return F.get(F.transform(F.array(known), lambda t: self._fold(word, t["pairs"], t["bytes"])), F.lit(0))

    def _fold(self, word: Column, pairs: Column, bytes_: Column) -> Column:
        latin = F.decode(word.cast("binary"), "ISO-8859-1")
        places = F.sequence(F.lit(1), F.octet_length(word))
        raw = F.transform(places, lambda i: F.get(bytes_, F.ascii(F.substring(latin, i, F.lit(1)))))
        bind = lambda value, f: F.get(F.transform(F.array(value), f), F.lit(0))
        start = bind(raw, lambda x: F.transform(x, lambda a, j: self.linked(pairs, a, F.coalesce(F.get(x, j + 1), _long(_NONE)))))

        def merge(x: Column, least: Column) -> Column:
            new = F.shiftright(least, BITS)

            def at(p: Column) -> Column:
                left = F.when(p > 1, F.array(self.linked(pairs, F.get(x, p - 2).bitwiseAND(_long(_MASK)), new))).otherwise(F.array().cast("array<bigint>"))
                own = F.when(p + 1 < F.size(x), self.linked(pairs, new, F.get(x, p + 1).bitwiseAND(_long(_MASK)))).otherwise(new.bitwiseOR(_long(_NONE << BITS)))
                return F.concat(F.slice(x, F.lit(1), F.greatest(p - 2, F.lit(0))), left, F.array(own), F.slice(x, p + 2, F.size(x)))

            return bind(F.array_position(x, least).cast("int"), at)

        def step(x: Column, _: Column) -> Column:
            return bind(F.array_min(x), lambda least: F.when(least >= _long(_NONE << BITS), x).otherwise(merge(x, least)))

        return F.transform(F.aggregate(places, start, step), lambda e: e.bitwiseAND(_long(_MASK)).cast("int"))

    def words(self, text: Column) -> Column:
        return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(self.pattern), F.lit(0))


def decode(ids: Column, path: str) -> Column:
    """Bytes of a row of ids."""
    table_ = ranks(path)
    pieces = [""] * (max(table_.values()) + 1)
    for t, r in table_.items():
        pieces[r] = t.decode("latin-1")
    known = F.from_json(F.lit(json.dumps(pieces)), "array<string>")
    return F.encode(F.array_join(F.transform(ids, lambda i: F.get(known, i)), ""), "ISO-8859-1")


#: Of a packed number: lesser ones are a byte; of others, the byte has what is above so many bits; the last one stands for all from there on.
_NEAR, _LOW = 192, 13
_TOP = 255 - _NEAR


def _packed(values: np.ndarray, at: np.ndarray) -> pa.Array:
    """Runs of whole numbers below 2**31: their first bytes, what these leave of the larger numbers by bytes, each part compressed for itself."""
    far = values >= _NEAR
    rest = values[far].astype(np.int64) - _NEAR
    top = np.minimum(rest >> _LOW, _TOP)
    first = values.astype(np.uint8)
    first[far] = _NEAR + top
    rest -= top << _LOW
    low, high, more = rest.astype(np.uint8), (rest >> 8).astype(np.uint8), (rest[top == _TOP] >> 16).astype("<u2")
    f = np.concatenate([[0], np.cumsum(far)])[at].tolist()
    m = np.concatenate([[0], np.cumsum(top == _TOP)])[f].tolist()
    z, out, at = zstandard.ZstdCompressor(1), [], at.tolist()
    for k in range(len(at) - 1):
        one, two = z.compress(first[at[k] : at[k + 1]]), z.compress(low[f[k] : f[k + 1]])
        out.append(b"".join((len(one).to_bytes(4, "little"), len(two).to_bytes(4, "little"), one, two, z.compress(high[f[k] : f[k + 1]].tobytes() + more[m[k] : m[k + 1]].tobytes()))))
    return pa.array(out, pa.binary())


def _unpacked(column) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of packed runs, and n+1 places."""
    z, firsts, lows, highs, mores = zstandard.ZstdDecompressor(), [], [], [], []
    for x in column.to_pylist():
        i = 8 + int.from_bytes(x[:4], "little")
        j = i + int.from_bytes(x[4:8], "little")
        firsts.append(z.decompress(x[8:i]))
        lows.append(z.decompress(x[i:j]))
        high = z.decompress(x[j:])
        highs.append(high[: len(lows[-1])])
        mores.append(high[len(lows[-1]) :])
    at = np.concatenate([[0], np.cumsum([len(x) for x in firsts], dtype=np.int64)])
    first, low, high = (np.frombuffer(b"".join(x), np.uint8) for x in (firsts, lows, highs))
    out, far = first.astype(np.int32), np.flatnonzero(first >= _NEAR)
    rest = low.astype(np.int64) | high.astype(np.int64) << 8
    rest[first[far] == 255] |= np.frombuffer(b"".join(mores), "<u2").astype(np.int64) << 16
    out[far] = rest + (first[far].astype(np.int64) - _NEAR << _LOW) + _NEAR
    return out, at


def _steps(places: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Rising numbers of each run as differences."""
    out = np.diff(places, prepend=0)
    out[at[:-1][np.diff(at) > 0]] = places[at[:-1][np.diff(at) > 0]]
    return out


def _sums(steps: np.ndarray, at: np.ndarray) -> np.ndarray:
    """What _steps made differences of."""
    total = np.cumsum(steps, dtype=np.int64)
    return (total - np.repeat(np.concatenate([[0], total])[at[:-1]], np.diff(at))).astype(np.int32)


def _coded(docs: DataFrame, words: Column, buckets: int) -> tuple[DataFrame, DataFrame]:
    """Two tables of one pass: documents as numbers of words (columns of docs but for text; chunk, numbers), and the chunks' words (bucket, chunk, words, places)."""
    names = [c for c in docs.columns if c != "text"]
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    own = pa.schema([("chunk", pa.int64()), ("numbers", pa.binary()), ("bucket", pa.int32()), ("words", pa.list_(pa.string())), ("places", pa.binary())])

    def code(batches):
        from pyspark import TaskContext

        chunk, index, schema = TaskContext.get().partitionId() << 24, {}, None

        def listed() -> Iterator[pa.RecordBatch]:
            known = list(index)
            to = np.fromiter((zlib.crc32(w.encode()) % buckets for w in known), np.int64, len(known))
            order = np.argsort(to, kind="stable")
            cuts = np.searchsorted(to[order], np.arange(buckets + 1))
            on = [k for k in range(buckets) if cuts[k] < cuts[k + 1]]
            ends = np.append(cuts[on], len(known))
            spelled = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(known, pa.string()).take(pa.array(order)))
            made = [pa.array(np.full(len(on), chunk)), pa.nulls(len(on), pa.binary()), pa.array(on, pa.int32()), spelled, _packed(_steps(order, ends), ends)]
            yield pa.RecordBatch.from_arrays([*(pa.nulls(len(on), schema.field(c).type) for c in names), *made], [*names, *own.names])

        for b in batches:
            schema = b.schema
            rows = b.column("words")
            flat_ = rows.flatten().dictionary_encode()
            which = flat_.indices.to_numpy(zero_copy_only=False) if len(flat_) else np.zeros(0, np.int32)
            # frequent words come first, so that their numbers are small
            order = np.argsort(-np.bincount(which, minlength=len(flat_.dictionary)), kind="stable")
            number = np.empty(len(order), np.int32)
            number[order] = np.fromiter((index.setdefault(w, len(index)) for w in flat_.dictionary.take(pa.array(order)).to_pylist()), np.int32, len(order))
            at = np.asarray(rows.offsets, np.int64)
            numbers = number[which]
            n = b.num_rows
            made = [pa.array(np.full(n, chunk)), _packed(numbers, at - at[0]), *(pa.nulls(n, own.field(c).type) for c in ("bucket", "words", "places"))]
            del rows, flat_
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), *made], [*names, *own.names])
            if len(index) >= CHUNK_WORDS:
                yield from listed()
                chunk, index = chunk + 1, {}
        if index:
            yield from listed()

    out = ", ".join([*(f"{c} {kinds[c]}" for c in names), "chunk long, numbers binary, bucket int, words array<string>, places binary"])
    coded = docs.select(*names, words.alias("words")).mapInArrow(lean(code), out)
    # a batch of texts becomes one of all their words, on both sides of the pipe
    with narrow(docs.sparkSession):
        return durable_parts(coded, F.col("bucket").isNotNull(), "coded", "zstd")


def _gather(t: pa.Table) -> pa.Table:
    """Each word of a bucket with its occurrences, TOGETHER of them at most in a row."""
    words = pa.concat_arrays([c.flatten() for c in t["words"].chunks]).dictionary_encode()
    which = words.indices.to_numpy(zero_copy_only=False)
    steps, ends = _unpacked(t["places"])
    places, chunks = _sums(steps, ends), np.repeat(t["chunk"].to_numpy(), np.diff(ends))
    order = np.argsort(which, kind="stable")
    which = which[order]
    head = np.flatnonzero(np.concatenate([[True], which[1:] != which[:-1]]))
    nth = np.arange(len(which)) - np.repeat(head, np.diff(np.append(head, len(which))))
    head = np.flatnonzero(nth % TOGETHER == 0)
    runs = pa.array(np.append(head, len(which)).astype(np.int32))
    return pa.table({"word": words.dictionary.take(pa.array(which[head])), "chunks": pa.ListArray.from_arrays(runs, pa.array(chunks[order])), "places": pa.ListArray.from_arrays(runs, pa.array(places[order]))})


def encode_documents(docs: DataFrame, path: str, python_pattern: str = public_tokenizers.PATTERN, keep_text: bool = True) -> DataFrame:
    """docs with ids; without text, where that isn't kept."""
    spark = docs.sparkSession
    bpe = Bpe(path, python_pattern, spark)
    docs = docs.drop("ids")
    own = inside(docs, "text")
    text = own.columns.index("text")
    kept = [i for i in range(len(own.columns)) if keep_text or i != text]
    # own names inside, so that no column of docs can clash
    inner = own.select(F.col("text"), *[F.col(own.columns[i]).alias(f"c{k}") for k, i in enumerate(kept)])
    targets = width(spark)
    numbered, listed = _coded(inner, bpe.words(F.col("text")), 8 * targets)
    settle(spark, 5)
    # dealt by number, so that small buckets of words, each much work, don't come together in one task
    gathered = listed.select("bucket", "chunk", "words", "places").repartition(targets, "bucket").groupBy("bucket").applyInArrow(lean_group(_gather), "word string, chunks array<bigint>, places array<int>")
    odd = odd_tokens(path)
    apart = (F.octet_length("word") > FOLD_BYTES) | F.col("word").isin([t.decode() for t in odd if _is_text(t)])
    folded = bpe.with_tables(gathered).select(F.when(~apart, bpe.word_ids(F.col("word"))).alias("ids"), F.when(apart, F.col("word")).alias("word"), "chunks", "places")
    # ids stand once for each word here; between the shuffles there is nothing smaller
    folded = durable(folded, "folded", "zstd")
    del gathered
    forget(listed, bpe.row)
    settle(spark, 5)
    made = pair_ids(path)
    shared = spark.sparkContext.broadcast((np.fromiter(made, np.int64, len(made)), np.fromiter(made.values(), np.int32, len(made)), byte_ids(path), odd))

    def deal(batches):
        pairs: dict[int, int] = {}

        def by_heap(word: str) -> list[int]:
            """Ids of a word that isn't folded."""
            left, right, first, odd = shared.value
            if (raw := word.encode()) in odd:
                return [odd[raw]]
            if not pairs:
                pairs.update(zip(left.tolist(), right.tolist()))
            return merge([first[x] for x in raw], pairs)

        for b in batches:
            ids = b.column("ids")
            if b.column("word").null_count < b.num_rows:
                ids = pa.array([x if w is None else by_heap(w) for x, w in zip(ids.to_pylist(), b.column("word").to_pylist())], pa.list_(pa.int32()))
            heads, values = np.asarray(ids.offsets, np.int64), np.asarray(ids.values)
            chunks, places = b.column("chunks"), b.column("places")
            word = np.repeat(np.arange(b.num_rows), np.diff(np.asarray(places.offsets)))
            chunk, place = np.asarray(chunks.flatten()), np.asarray(places.flatten())
            order = np.lexsort((place, chunk))
            chunk, place, word = chunk[order], place[order], word[order]
            lens = (heads[1:] - heads[:-1])[word]
            ends = np.concatenate([[0], np.cumsum(lens)])
            each = values[np.arange(ends[-1]) + np.repeat(heads[word] - ends[:-1], lens)]
            cut = np.flatnonzero(np.concatenate([[True], chunk[1:] != chunk[:-1]])) if len(chunk) else np.zeros(0, int)
            runs = np.append(cut, len(chunk))
            yield pa.RecordBatch.from_arrays([pa.array(chunk[cut]), _packed(_steps(place, runs), runs), _packed(lens, runs), _packed(each, ends[runs])], ["chunk", "places", "lens", "ids"])

    dealt = folded.mapInArrow(lean(deal), "chunk long, places binary, lens binary, ids binary")
    names = [f"c{k}" for k in range(len(kept))]
    kinds = [docs.schema[i].dataType.simpleString() for i in kept]
    left = numbered.select("chunk", F.lit(1).alias("side"), *names, "numbers", *[F.lit(None).cast("binary").alias(c) for c in ("places", "lens", "ids")])
    right = dealt.select("chunk", F.lit(0).alias("side"), *[F.lit(None).cast(k).alias(c) for c, k in zip(names, kinds)], F.lit(None).cast("binary").alias("numbers"), "places", "lens", "ids")

    def assemble(batches):
        now, held, heads, lens, values = None, [], None, None, None
        for b in batches:
            chunk, side = b.column("chunk").to_numpy(), b.column("side").to_numpy()
            cuts = np.flatnonzero(np.concatenate([[True], (chunk[1:] != chunk[:-1]) | (side[1:] != side[:-1]), [True]])) if len(chunk) else []
            for lo, hi in zip(cuts[:-1], cuts[1:]):
                if chunk[lo] != now:
                    now, held, lens = chunk[lo], [], None
                if not side[lo]:
                    (steps, at), (sizes, _), (each, _) = (_unpacked(b.column(c).slice(lo, hi - lo)) for c in ("places", "lens", "ids"))
                    held.append((_sums(steps, at), sizes, each))
                    continue
                if lens is None:
                    places, sizes, values = (np.concatenate([h[k] for h in held] or [np.zeros(0, np.int32)]) for k in range(3))
                    held = []
                    lens, heads = np.zeros(len(places), np.int32), np.zeros(len(places), np.int32)
                    lens[places], heads[places] = sizes, np.cumsum(sizes) - sizes
                for i in range(lo, hi, 512):  # rows of a slice are put together at once
                    number, at = _unpacked(b.column("numbers").slice(i, min(512, hi - i)))
                    n = lens[number]
                    ends = np.concatenate([[0], np.cumsum(n, dtype=np.int64)])
                    out = values[np.arange(ends[-1]) + np.repeat(heads[number] - ends[:-1], n)]
                    rows = pa.ListArray.from_arrays(pa.array(ends[at].astype(np.int32)), pa.array(out, pa.int32()))
                    yield pa.RecordBatch.from_arrays([*(b.column(c).slice(i, min(512, hi - i)) for c in names), rows], [*names, "ids"])

    both = left.unionByName(right).repartition(targets, "chunk").sortWithinPartitions("chunk", "side")
    out = both.mapInArrow(lean(assemble), ", ".join([*(f"{c} {k}" for c, k in zip(names, kinds)), "ids array<int>"]))
    return out.toDF(*[docs.columns[i] for i in kept], "ids")


def _is_text(raw: bytes) -> bool:
    try:
        return bool(raw.decode())
    except UnicodeDecodeError:
        return False


def digests(encoded: DataFrame, path: str) -> DataFrame:
    rows = encoded.select("doc_id", "ids")
    return rows.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2(decode(F.col("ids"), path), 256).alias("decoded_sha256"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op7: ids of all documents, and what decodes from them."""
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return digests(encode_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), path, keep_text=False), path)
