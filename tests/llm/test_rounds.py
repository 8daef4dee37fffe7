"""What the similarity join reads and how often it meets its members; hashes of words."""

import gc
import random

import numpy as np
import pytest

from broadsheet.llm import common, linededup, ngram, setjoin
from broadsheet.llm.words import word_hashes
from tests.llm import helpers

DOCS = "doc_id long, text string"


def _near_lines(n: int, seed: int) -> list[tuple[int, str]]:
    """Documents of one line each, in groups that share most words: chains, so that not all are near the first."""
    rng = random.Random(seed)
    out = []
    for g in range(n):
        words = [f"w{g}x{k}" for k in range(30)]
        for i in range(6):
            words = words.copy()
            words[rng.randrange(30)] = f"new{g}x{i}"
            out.append((len(out), " ".join(words)))
    return out


@pytest.mark.parametrize("partners", [8, 1, 0])
def test_few_partners_meet_in_one_round(spark, monkeypatch, partners):
    rows, calls, plain = _near_lines(20, 5), [], setjoin.rest
    monkeypatch.setattr(linededup, "rest", lambda *a, **b: calls.append(b) or plain(*a, **b))
    monkeypatch.setattr(setjoin, "PARTNERS", partners)
    got = {r["doc_id"]: r["text"] for r in linededup.dedup_lines(spark.createDataFrame(rows, DOCS)).collect()}
    assert got == helpers.kept_lines(rows)
    assert len(calls) <= (1 if partners == 8 else 2)


def test_tiers_are_counted_without_bitmaps(spark, monkeypatch):
    """Bitmaps join where rows are dealt: the tables before that don't read them."""
    rows, read, plain = _near_lines(20, 6), {}, setjoin.durable

    def durable(df, name, *more):
        read.setdefault(name, []).append(df.inputFiles())
        return plain(df, name, *more)

    monkeypatch.setattr(setjoin, "durable", durable)
    got = {r["doc_id"]: r["component_id"] for r in ngram.near_groups(spark.createDataFrame(rows, DOCS)).collect()}
    sets = [helpers.shingles(t) for _, t in rows]
    assert got == helpers.groups([i for i, _ in rows], lambda i, j: helpers.near(sets[i], sets[j]))
    assert read["tiersizes"] and not any("/signs-" in f for files in read["tiersizes"] for f in files)
    assert any("/signs-" in f for f in read["rest"][0])


def test_word_hashes_tell_words_apart():
    rng = random.Random(7)
    words = sorted({"".join(rng.choice("abABé中.\x0b\x1f"[: rng.choice([3, 9])]) for _ in range(n)).replace("\x0b", "") for n in (*range(1, 40), 255, 256, 257, 300, 1000) for _ in range(6)} - {""})
    rows = [f" {a}\t{b}\n{a}\x0c" for a, b in zip(words, words[1:])] + ["", "\n", "ends", "starts here"]
    raw = [r.encode() for r in rows]
    at = np.concatenate([[0], np.cumsum([len(r) for r in raw])])
    hashes, counts = word_hashes(np.frombuffer(b"".join(raw), np.uint8), at)
    found: dict[str, int] = {}
    for i, r in enumerate(rows):
        told = helpers.WORD.findall(helpers.lower(r))
        assert counts[i + 1] - counts[i] == len(told)
        for w, h in zip(told, hashes[counts[i] : counts[i + 1]].tolist()):
            assert found.setdefault(w, h) == h
    assert len(set(found.values())) == len(found)


@pytest.fixture
def wide(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    yield spark
    spark.conf.set("spark.sql.shuffle.partitions", before)


def test_few_pairs_take_few_tasks(wide, monkeypatch):
    """A round over few pairs isn't dealt over as many tasks as the whole input."""
    rows, tasks, plain = _near_lines(40, 8), {}, setjoin.durable

    def durable(df, name, *more):
        out = plain(df, name, *more)
        tasks.setdefault(name, []).append(len(out.inputFiles()))
        return out

    monkeypatch.setattr(setjoin, "durable", durable)
    got = {r["doc_id"]: r["text"] for r in linededup.dedup_lines(wide.createDataFrame(rows, DOCS)).collect()}
    assert got == helpers.kept_lines(rows)
    assert tasks["links"] and max(tasks["links"]) <= 8


def test_a_worker_walks_through_its_modules_once():
    gc.unfreeze()
    try:
        assert list(common.lean(lambda batches: batches)(iter([1, 2]))) == [1, 2]
        assert gc.get_freeze_count() > 1000
    finally:
        gc.unfreeze()


def test_sketch_comes_in_few_jobs(wide):
    """As many jobs as partitions fill the driver with their records: 211 of them a sketch on check_h."""
    wide.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    wide.sparkContext.setJobGroup("sketch", "sketch")
    try:
        docs = wide.createDataFrame(_near_lines(10, 9), DOCS)
        read = ngram.document_units(5)
        surveyed = setjoin.survey(docs.select("text"), read, {}, lambda b, found: [])
        before = len(wide.sparkContext.statusTracker().getJobIdsForGroup("sketch"))
        counts = setjoin.sketch(surveyed)
        jobs = len(wide.sparkContext.statusTracker().getJobIdsForGroup("sketch")) - before
    finally:
        wide.sparkContext._jsc.clearJobGroup()
        wide.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert jobs <= setjoin.FETCHES + 4
    assert counts.sum() == sum(len(helpers.shingles(t)) for _, t in _near_lines(10, 9))
