"""Merge-dropout draws for every candidate of every occurrence."""

from collections import Counter

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F

from fathomline.llm import merge_dropout
from fathomline.llm.queries import tokenizer_path

PIECES = tokenizer_path("piece_bpe_32k.model")
M = (1 << 64) - 1


def mix(x):
    x ^= x >> 30
    x = x * 0xBF58476D1CE4E5B9 & M
    x ^= x >> 27
    x = x * 0x94D049BB133111EB & M
    return x ^ x >> 31


def brute(text, seed, key):
    """A plain agenda over the whole text: rank and leftmost place first, each candidate drawn for once."""
    if not text:
        return []
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    score, byte = {}, {}
    for i in range(model.get_piece_size()):
        if model.is_byte(i):
            byte[int(model.id_to_piece(i)[3:5], 16)] = i
        elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
            score[model.id_to_piece(i)] = (-model.get_score(i), i)
    digest = int.from_bytes(merge_dropout.hashlib.blake2b(key, digest_size=8, key=seed.to_bytes(8, "little")).digest(), "little")
    symbols = [(k, "\0" if c == merge_dropout.MARK else merge_dropout.MARK if c == " " else c) for k, c in enumerate(" " + text)]
    end, limit = len(symbols), int(merge_dropout.DROPOUT * 2**32)
    drawn = {}
    while True:
        agenda = []
        for i in range(len(symbols) - 1):
            (a, x), (b, y) = symbols[i : i + 2]
            if x + y in score:
                z = symbols[i + 2][0] if i + 2 < len(symbols) else end
                if (a, b, z) not in drawn:
                    place = a * 0x9E3779B97F4A7C15 + b * 0xD6E8FEB86659FD93 + z * 0xA0761D6478BD642F
                    drawn[a, b, z] = mix(digest + place & M) >> 32 >= limit
                if drawn[a, b, z]:
                    agenda.append((score[x + y][0], i))
        if not agenda:
            break
        i = min(agenda)[1]
        symbols[i : i + 2] = [(symbols[i][0], symbols[i][1] + symbols[i + 1][1])]
    out = []
    for _, s in symbols:
        out += [score[s][1]] if s in score else [byte[b] for b in (merge_dropout.MARK if s == "\0" else s).encode()]
    return out


TEXTS = [
    "the internationalisation of communication and-so-on, incomprehensibilities 12,345.67 naïve漢字 and the end",
    "  two  leading\n\nand \t odd   spaces ",
    "▁ mark \U0001f600 é ß",
    "x",
    "",
    "pneumonoultramicroscopicsilicovolcanoconiosis" * 4,
    " " * 150,
]


def test_a_word_has_more_than_a_few_segmentations(spark):
    docs = spark.createDataFrame([(i, "international") for i in range(4000)], "doc_id long, text string")
    found = Counter(tuple(r.ids) for r in merge_dropout.encode_texts(docs, PIECES, seed=3).collect())
    assert len(found) > 20
    short = spark.createDataFrame([(i, "the") for i in range(4000)], "doc_id long, text string")
    assert len({tuple(r.ids) for r in merge_dropout.encode_texts(short, PIECES, seed=3).collect()}) > 2
    within = merge_dropout.encode_batch(["international " * 2000], PIECES, 3, [b"i1"])[0].tolist()
    assert len(set(map(tuple, np.array_split(within, 2000)))) > 20


def test_each_candidate_is_skipped_at_the_rate():
    limit, places = int(merge_dropout.DROPOUT * 2**32), np.arange(100_000)
    for step in (1, 2, 7):
        skips = np.stack([merge_dropout.draws(np.uint64(5), places + k, places + k + step, places + k + 2 * step) < limit for k in range(8)])
        assert np.abs(skips.mean(1) - 0.1).max() < 0.006
        both = skips.astype(float) @ skips.T / len(places)
        assert np.abs(both[~np.eye(8, dtype=bool)] - 0.01).max() < 0.003


@pytest.mark.parametrize("columns, chars", [(8192, 1 << 20), (3, 1 << 20), (8192, 7)])
def test_agendas_in_step_are_a_plain_agenda(monkeypatch, columns, chars):
    monkeypatch.setattr(merge_dropout, "COLUMNS", columns)
    monkeypatch.setattr(merge_dropout, "CHARS", chars)
    for seed, key in ((5, b"i1"), (5, b"i2"), (6, b"i1")):
        got = merge_dropout.encode_batch(TEXTS, PIECES, seed, [key] * len(TEXTS))
        assert [g.tolist() for g in got] == [brute(t, seed, key) for t in TEXTS]


def test_random_texts_are_a_plain_agenda():
    from hypothesis import given, settings
    from hypothesis import strategies as st

    @settings(max_examples=60, deadline=None)
    @given(st.lists(st.text(st.sampled_from("aeinst  .\n1é漢▁"), max_size=30), max_size=4), st.integers(0, 99))
    def check(texts, seed):
        got = merge_dropout.encode_batch(texts, PIECES, seed, [b"i%d" % i for i in range(len(texts))])
        assert [g.tolist() for g in got] == [brute(t, seed, b"i%d" % i) for i, t in enumerate(texts)]
        assert [merge_dropout.decode(g, PIECES) for g in got] == texts

    check()


def test_whole_documents_are_a_plain_agenda(sample):
    docs = sample.where("length(text) < 700").orderBy("doc_id").limit(12)
    got = {r.doc_id: list(r.ids) for r in merge_dropout.encode_texts(docs.select("doc_id", "text", F.lit(1).alias("ids")), PIECES, seed=11).collect()}
    for r in docs.collect():
        assert got[r.doc_id] == brute(r.text or "", 11, merge_dropout.text_key(r.doc_id, r.text or ""))
