"""The filing of drawn fingerprints: whatever differs in a draw by its budget meets under a key, what exceeds it does not link."""

import numpy as np
import pyarrow as pa
from plumbline.llm import widedup


def keys_of(f):
    batch = pa.RecordBatch.from_arrays([pa.array(f[:, i].view(np.int64)) for i in range(widedup.WORDS)], names=widedup.F_COLS)
    rows = pa.Table.from_batches(widedup._ring_rows([batch]))
    return rows["key"].to_numpy().reshape(len(f), -1)


def flipped(f, bits):
    out = f.copy()
    for p in bits:
        out[p >> 6] ^= np.uint64(1) << np.uint64(p & 63)
    return out


def prints(n):
    return np.random.default_rng(3).integers(0, 2**63, (n, widedup.WORDS), dtype=np.int64).view(np.uint64)


def test_every_difference_within_the_budget_meets():
    (f,) = prints(1)
    for draw, segments in enumerate(widedup._DRAWN):
        drawn = segments[segments < widedup.BITS].tolist()
        others = [p for p in range(widedup.BITS) if p not in drawn]
        near = [flipped(f, [p, *others[: widedup.MAX_BITS - 1]]) for p in drawn]
        keys = keys_of(np.stack([f, *near])).reshape(1 + len(near), widedup.DRAWS, widedup.SEGMENTS)
        assert (keys[1:, draw] == keys[0, draw]).any(axis=1).all()


def test_the_whole_chain_has_its_share_of_the_budget():
    """Two segments agree and the third differs in one bit or in two: only the first pair is linked under the key."""
    (f,) = prints(1)
    last = widedup._DRAWN[4, 2].tolist()
    for bits, linked in ((last[:1], 1), (last[:2], 0)):
        both = np.stack([f, flipped(f, bits)])
        key = keys_of(both)[:, 4 * widedup.SEGMENTS]
        assert key[0] == key[1]
        assert widedup._edges_of(both, key, np.array([0])).num_rows == linked
        assert len(widedup._large(both, widedup._chain_end(both, key))[0]) == linked


def test_recall_counts_every_budget():
    assert [widedup.budget(n) for n in (1, 2, 3)] == [0, 0, 1]
    assert widedup.recall(widedup.DRAWS - 1) < widedup.RECALL <= widedup.recall(widedup.DRAWS)
