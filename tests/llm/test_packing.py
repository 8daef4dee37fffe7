"""Runs of word numbers between the passes of the encoder."""

import numpy as np
import zstandard

from broadsheet.llm.bpe import _packed, _unpacked


def test_numbers_of_any_size_come_back():
    edges = [0, 1, 191, 192, 193, 192 + 8191, 192 + 8192]
    edges += [192 + (63 << 13) + k for k in (-1, 0, 65535, 65536)] + [(1 << 31) - 1]
    values = np.array(edges * 3, np.int32)
    for at in ([0, 36], [0, 0, 5, 12, 12, 36], range(37)):
        got, ends = _unpacked(_packed(values, np.array(at)))
        assert got.dtype == np.int32 and got.tolist() == values.tolist() and ends.tolist() == list(at)


def test_parts_are_compressed_apart():
    """A code for all bytes of numbers together takes a tenth more at least."""
    values = (np.random.default_rng(2).zipf(1.3, 20_000) % 200_000).astype(np.int32)
    at = np.arange(0, 20_001, 1000)
    z = zstandard.ZstdCompressor(1)
    together = sum(len(z.compress(values[i:j].view(np.uint8).reshape(-1, 4).T.tobytes())) for i, j in zip(at[:-1], at[1:]))
    assert sum(map(len, _packed(values, at).to_pylist())) < 0.9 * together
