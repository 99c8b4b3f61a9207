"""The model's counts belong to one context each, however many there are."""

from collections import Counter

import numpy as np
import zstandard

from graphloom.llm.lm_score import ORDERS, PIECE, _tokens, all_runs, by_bucket, byte_triples, code_of, corpus_code, counted_keys, keys_of, log10_probabilities, packed, places, predict, ragged, send_runs, stretched


def test_no_two_contexts_share_counts():
    """Random bytes: each prediction on a path is that of its own context and place, from all chunks' training texts."""
    rng = np.random.default_rng(1)
    texts = [rng.integers(1, 40, 3_000).astype(np.uint8).tobytes() for _ in range(8)]
    trains = [True] * 6 + [False] * 2
    code = code_of(texts[:6])
    chunks = [counted_keys(texts[:4], trains[:4]), counted_keys(texts[4:], trains[4:])]
    buckets = 4
    asked = [dict(send_runs(*c, buckets)) for c in chunks]
    keys = chunks[1][0]
    length = code.length[code.at(keys)]
    begin = np.cumsum(length) - length
    value = np.empty(int(length.sum()), np.int8)
    for b, at in by_bucket(keys, buckets):
        answers = dict(predict(code, [0, 1], [a[b] for a in asked]))
        value[ragged(begin[at], length[at])] = np.frombuffer(zstandard.decompress(answers[1]), np.int8)
    # brute force: outcomes by order, context and place
    counts: Counter = Counter()

    def paths(text):
        x = bytes(6) + text + b"\0"
        for i in range(6, len(x)):
            pair = int(code.at(np.array([x[i - 2] << 16 | x[i - 1] << 8 | x[i]], np.uint64))[0])
            a = code.begin[pair]
            yield x, i, [(int(code.node[a + j]), bool(code.outcome[a + j])) for j in range(code.length[pair])]

    for text in texts[:6]:
        for x, i, path in paths(text):
            for order in ORDERS:
                counts.update((order, x[i - order : i], node, bit) for node, bit in path)
    where = {int(k): n for n, k in enumerate(keys.tolist())}
    for text in texts[4:]:
        for x, i, path in paths(text):
            for tag, order in enumerate(ORDERS):
                key = tag << 56 | int.from_bytes(x[i - order : i], "big") << 8 | x[i]
                at = begin[where[key]]
                ns = np.array([[counts[order, x[i - order : i], node, bit] for bit in (False, True)] for node, _ in path])
                assert (value[at : at + len(path)] == stretched(ns[:, 0], ns[:, 1])).all()


def test_tokens_are_told_apart():
    texts = [b"", b" ", b"a", b"a b", b"  hello\nworld  ", "é ü\x0b x".encode(), b"abcdefgh abcdefghi abcdefgh\0 " + b"q" * 40, b"\0 z", b"a" * 17 + b" " + b"a" * 16]
    texts += [b" ".join(bytes([97 + i * j % 3]) * (i * j % 11) for j in range(50)) for i in range(20)]
    sizes, keys, back = _tokens(texts)
    want = [t.split() + [None] for t in texts]
    assert sizes.tolist() == [len(w) for w in want]
    number = {}
    assert all(number.setdefault(w, n) == n for w, n in zip((w for own in want for w in own), back.tolist(), strict=True))
    assert len(set(number.values())) == len(number) == len(keys)


def test_code_of_chunks_is_that_of_all_texts(spark):
    """Summed over notes of chunks the code is that of the training texts together."""
    from collections import Counter as Count

    from graphloom.llm import lm_score
    from graphloom.llm.common import write_chunks

    texts = [b"", b"a", b"ab ab", "é x".encode(), b"the cat and the hat " * 9]
    triples, n = byte_triples(texts)
    want = Count(bytes(t[i : i + 3]) for t in (b"\0\0" + t + b"\0" for t in texts) for i in range(len(t) - 2))
    assert {int(k).to_bytes(3, "big"): int(c) for k, c in zip(triples, n, strict=True)} == want
    df = spark.createDataFrame([(i, t.decode()) for i, t in enumerate(texts * 5)], "doc_id long, text string").repartition(4)

    def note(table):
        found, m = byte_triples([t.encode() for t in table["text"].to_pylist()])
        return lm_score._note(m, found)

    code, own = corpus_code(write_chunks(df, ["doc_id", "text"], 50, note)), code_of(texts * 5)
    assert (code.length == own.length).all() and (code.node == own.node).all() and (code.state == own.state).all()


def test_texts_score_among_others_as_alone():
    """Texts of one piece are gone through byte by byte of all, a long one in several pieces; each is scored as if by itself."""
    rng = np.random.default_rng(3)
    sizes = [0, 1, 31, 32, 33, 700, 700, 5_000, 0, PIECE + 40_000, 64]
    texts = [rng.choice(np.frombuffer(b"abcde  \n", np.uint8), n).tobytes() for n in sizes]
    code = code_of(texts)

    def scored(own):
        runs, _ = all_runs(own)
        keys, at = keys_of(runs)
        length = code.length[code.at(keys)]
        value = keys_hash(keys).repeat(length).astype(np.int8)
        return log10_probabilities(code, own, runs, packed(code, runs, at, np.cumsum(length) - length, value))

    def keys_hash(keys):  # any prediction will do, if it is the key's
        return (keys % np.uint64(251)).astype(np.int64) - 125

    among = scored(texts)
    assert np.allclose(among, [scored([t])[0] for t in texts], rtol=1e-9, atol=0)


def test_places():
    rng = np.random.default_rng(4)
    runs = np.unique(rng.integers(0, 2**56, 500).astype(np.uint64))
    for n in (0, 1, 2_000):
        at = rng.integers(0, len(runs), n)
        assert places(runs[at], runs).tolist() == at.tolist()
