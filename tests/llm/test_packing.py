"""Packing: exact round trip of every id, and no padding."""

import zlib

import numpy as np
import pytest

from rootstone.llm import packing
from rootstone.llm.queries import vocabulary

SCHEMA = "doc_id long, text string, start string, id string, length string"


def texts():
    draw = np.random.default_rng(3)
    words = "the of naïve über 漢字 x1 12345 don't   \u0085 <|endoftext|> \x1c 👍🏽 ﬁ".split(" ")
    out = [" ".join(draw.choice(words, int(draw.integers(0, 500)))) for _ in range(60)]
    return out + [None, "", " ", "\n\n", "a" * 5000, "the " * 6000, "<|endoftext|>", "tab\tnew\r\nline\x0b\x0c"]


def ids_of(text):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(vocabulary()["tokenizer"])
    return np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], "<u4")


def check(found, docs, longest=1024):
    by_doc, by_sequence = {}, {}
    for r in found:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    assert by_doc.keys() == docs.keys()
    for i, pieces in by_doc.items():
        at = 0
        for r in sorted(pieces, key=lambda r: r.start):
            part = docs[i][r.start : r.start + r.length]
            assert r.start == at and r.length == len(part) > 0 and r.ids_crc32 == zlib.crc32(part.tobytes()) and r.doc_tokens == len(docs[i])
            at += r.length
        assert at == len(docs[i])
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at == pieces[0].sequence_length <= longest and at & (at - 1) == 0
    return by_sequence


@pytest.mark.parametrize("pool", [4096, 9])
def test_round_trip(frame, monkeypatch, pool):
    monkeypatch.setattr(packing, "POOL", pool)
    rows = list(enumerate(texts()))
    found = packing.pack(frame([(*r, *"abc") for r in rows], SCHEMA), **vocabulary()).collect()
    check(found, {i: ids_of(t) for i, t in rows})


def test_packer_alone():
    draw = np.random.default_rng(8)
    for tiers in ((1024, 512, 256, 128), (64,), (32, 8)):
        packer = packing.Packer(tiers, 3)
        docs = {i: draw.integers(0, 9, int(draw.integers(1, 3000 if tiers[0] > 64 else 200))).astype("<u4") for i in range(400)}
        for i, ids in docs.items():
            packer.add(i, ids)
        packer.pack(True)

        class Row:
            def __init__(self, r):
                self.doc_id, self.start, self.length, self.ids_crc32, self.sequence_id, self.offset, self.sequence_length, self.place = r
                self.doc_tokens = len(docs[self.doc_id])

        sequences = check([Row(r) for r in packer.rows], docs, tiers[0])
        whole = sum(s[0].sequence_length in tiers for s in sequences.values())
        assert whole >= 0.9 * len(sequences)
        places = {}
        for s in sequences.values():
            places.setdefault(s[0].sequence_length, []).append(s[0].place)
        assert all(sorted(p) == list(range(len(p))) for p in places.values())


def test_step_groups_are_balanced_over_partitions(spark, monkeypatch):
    monkeypatch.setattr(packing, "STEP_TOKENS", 2048)
    draw = np.random.default_rng(2)
    rows = [(i, " ".join(["w"] * int(draw.integers(1, 900)))) for i in range(240)]
    found = packing.pack(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), **vocabulary()).collect()
    assert len({r.sequence_id >> packing.PART_BITS for r in found}) == 5
    groups = {}
    for r in {r.sequence_id: r for r in found}.values():
        groups.setdefault((r.sequence_length, r.step), []).append(r.sequence_length)
    for (length, step), tokens in groups.items():
        assert sum(tokens) == 2048 or ((length, step + 1) not in groups and sum(tokens) < 2048)
    assert sum(len(g) for g in groups.values()) == len({r.sequence_id for r in found}) and len(groups) > 20


def test_slow_and_fast_agree():
    v = vocabulary()
    both = packing.Encoder(**{"path": v["tokenizer"], "ranks": v["ranks"], "pattern": v["pattern"]})
    alone = packing.Encoder(v["tokenizer"], None, None)
    for text in [t for t in texts() if t]:
        assert np.array_equal(both.ids(text), alone.ids(text))


def test_repeats_and_nothing(frame):
    twice = packing.pack(frame([(1, "a b", *"abc"), (1, "a b", *"abc"), (None, None, *"abc")], SCHEMA), **vocabulary()).collect()
    assert sorted((r.doc_id or 0, r.length) for r in twice if r.start == 0)[0] == (0, 1) and sum(r.length for r in twice) == 7
    assert packing.pack(frame([], SCHEMA), **vocabulary()).count() == 0
