import re
import tracemalloc

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from oddlot.llm import recompression
from oddlot.llm.recompression import representatives
from oddlot.llm.tokens import all_shingles, find_words, shingle_hashes, slices

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TEXT = st.text(alphabet="ab é\n\t  A", max_size=40)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), TEXT), max_size=6), st.integers(1, 30))
def test_words_and_their_hashes_follow_the_pattern(texts, size):
    seen, found = {}, []
    for i, j, data, offsets in slices(pa.array(texts, pa.string()), size):
        words = find_words(data, offsets)
        hashes = words.hashes(lower=True)
        for d in range(j - i):
            span = range(words.first[d], words.first[d + 1])
            found.append([bytes(data[words.starts[x] : words.ends[x]]).decode() for x in span])
            for x in span:
                word = bytes(data[words.starts[x] : words.ends[x]]).decode()
                low = re.sub("[A-Z]", lambda m: m[0].lower(), word)
                assert seen.setdefault(low, hashes[x]) == hashes[x]
        values, begin = all_shingles(hashes, words.first, 3)
        for d in range(j - i):
            own = shingle_hashes(hashes[words.first[d] : words.first[d + 1]], 3)
            assert values[begin[d] : begin[d + 1]].tolist() == own.tolist()
    assert found == [WORD.findall(t or "") for t in texts]
    assert len(set(seen.values())) == len(seen)


def test_equal_windows_have_equal_keys_wherever_they_stand():
    dice = np.random.default_rng(3)
    for alphabet in (2, 5, 400):
        shared = dice.integers(0, alphabet, 90)
        docs = [np.concatenate((dice.integers(0, alphabet, n), shared, dice.integers(0, alphabet, m))) for n, m in ((0, 5), (33, 0), (7, 61))]
        docs.append(np.concatenate((np.zeros(80, dtype=np.int64), shared)))
        words = np.concatenate(docs).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        first = np.concatenate(([0], np.cumsum([len(d) for d in docs])))
        windows, keys = representatives(words, first, 50)
        assert len(windows) == sum(len(d) - 49 for d in docs)
        by_content = {}
        for p, key in zip(windows, keys, strict=True):
            assert by_content.setdefault(words[p : p + 50].tobytes(), key) == key


def test_what_a_worker_holds_does_not_follow_the_batch():
    """An executor's workers share what its heap leaves, so a batch of 12 MB may take a few times a slice."""
    text = " ".join(f"w{i * 7919 % 100003}" for i in range(330))
    batch = pa.RecordBatch.from_arrays([pa.array(range(5000)), pa.array([text] * 5000)], names=["doc_id", "text"])
    tracemalloc.start()
    rows = sum(out.num_rows for out in recompression._facts(50)(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows == 5000 and peak < 40e6
