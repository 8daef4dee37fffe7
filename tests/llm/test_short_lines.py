"""op4 on lines of fewer than five words: their whole sequence counts as one shingle."""

import numpy as np

from broadsheet.llm import linededup
from broadsheet.llm.common import mix
from broadsheet.llm.words import _PLACE, shingles
from tests.llm import helpers

DOCS = "doc_id long, text string"


def kept(rows):
    """As helpers.kept_lines, but every line with a word has shingles."""
    seen, out = [], {}
    for i, t in sorted(rows):
        out[i] = []
        for line in t.split("\n"):
            s = helpers.shingles(line)
            if not any(helpers.near(s, o) for o in seen):
                out[i].append(line)
            if s:
                seen.append(s)
    return {i: "\n".join(lines) for i, lines in out.items()}


def test_short_lines_go(spark):
    rows = [(1, "All rights reserved.\nLes.\none two three four five"), (2, "all  RIGHTS reserved.\n\nLes.\nnew"), (3, "rights reserved.\nLes.\n \none two three four\none two three four five six\nLes."), (4, "new\na b c d e f g h i\nreserved. rights")]
    got = {r["doc_id"]: r["text"] for r in linededup.dedup_lines(spark.createDataFrame(rows, DOCS)).collect()}
    assert got == kept(rows)
    assert got[2] == "\nnew" and got[4] == "a b c d e f g h i\nreserved. rights"


def test_short_sequences_hash_as_one():
    rng = np.random.default_rng(3)
    counts = np.concatenate([[0], np.cumsum(rng.integers(0, 8, 200))])
    words = rng.integers(0, 1 << 63, counts[-1]).astype(np.uint64)
    got, at = shingles(words, counts, 5)
    for i in np.flatnonzero((np.diff(counts) > 0) & (np.diff(counts) < 5)):
        w = words[counts[i] : counts[i + 1]]
        assert got[at[i] : at[i + 1]].tolist() == mix(np.array([(w * _PLACE[: len(w)]).sum(dtype=np.uint64) + np.uint64(len(w))])).tolist()
