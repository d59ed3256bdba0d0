import hashlib
import json
import struct
import zlib
from collections import defaultdict

import numpy as np
import pytest

from chunkframe.llm import bpe, packing
from chunkframe.llm.registry import tokenizer_path

PATH = tokenizer_path()


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


def test_lexicon_is_exact_and_minimal():
    words = {w.encode(): [i, i + 1] for i, w in enumerate(["tap", "taps", "top", "tops", "stop", "stops", "é", "a" * 50])}
    lexicon = bpe.Lexicon.mapped(bpe.Lexicon.compiled(words))
    asked = [*words, b"", b"ta", b"tapss", b"x", b"\xc3"]
    assert lexicon.find(asked) == [words.get(w) for w in asked]
    assert len(lexicon.final) < 2 + sum(len(w) for w in words) - 6  # tails are shared
    nothing = bpe.Lexicon.mapped(bpe.Lexicon.compiled({}))
    assert nothing.find([b"a", b""]) == [None, None]


def test_split_and_merges_equal_the_library(library):
    rng = np.random.default_rng(3)
    pool = [*range(0x9, 0x300), *range(0x2000, 0x2070), 0x3000, 0x4E00, 0xFEFF, 0x1680, 0x200B, 0x1F600, 0x0301, 0x2165, 0xAA]
    texts = ["".join(chr(c) for c in rng.choice(pool, 40)) for _ in range(300)] + ["  a  b\n\n c'll we'VE 'd x" * 3, "ab" * 400, " " * 301 + "x", "\x1c\x1d a\x1f b"]
    texts += ["".join(rng.choice(list("  \n\t\xa0\0ab1,'s"), rng.integers(0, 12))) for _ in range(3000)]
    vocab = bpe.vocabulary(PATH)
    for codec in (bpe.WordCodec(vocab, lambda ws: [np.array(vocab.merge(w.encode()), "<u4").tobytes() for w in ws]), bpe.by_library(PATH)):
        for t, packed in zip(texts, codec.packed(texts), strict=True):
            assert np.frombuffer(packed, "<u4").tolist() == library.encode(t, add_special_tokens=False).ids, repr(t)


def test_chunks_are_cut_where_no_word_goes_on(library):
    rng = np.random.default_rng(4)
    signs = ["a", "Bc", "é", "7", "ж", "漢", "’", ".", ",", "\n", " ", " ", "\t", "\xa0", "\1", "\2", "'s", "-", "...", "<|endoftext|>", *bpe.vocabulary(PATH).special]
    texts = ["".join(rng.choice(signs, rng.integers(0, 14))) for _ in range(4000)] + ["One, two.\nThree é. Four", ".a", "a.", "a.\n", "\nb"]
    vocab = bpe.vocabulary(PATH)
    for codec in (bpe.WordCodec(vocab, lambda ws: [np.array(vocab.merge(w.encode()), "<u4").tobytes() for w in ws]), bpe.by_library(PATH)):
        for at in (0, 0, 1):  # known chunks, and other ones beside them
            for t, packed in zip(texts[at:], codec.packed(texts[at:]), strict=True):
                assert np.frombuffer(packed, "<u4").tolist() == library.encode(t, add_special_tokens=False).ids, repr(t)


def test_a_chunk_is_split_once(monkeypatch):
    read, pretokens = [], bpe.pretokens
    monkeypatch.setattr(bpe, "pretokens", lambda t: read.append(len(t)) or pretokens(t))
    vocab = bpe.vocabulary(PATH)
    codec = bpe.WordCodec(vocab, lambda ws: [np.array(vocab.merge(w.encode()), "<u4").tobytes() for w in ws])
    texts = [f"Nun {k} Wörter, élan, und das.\nDann " + "noch mehr, viel mehr. " * 50 + "Ende" for k in range(40)]
    first = codec.packed(texts)
    assert sum(read) < 1000 < sum(map(len, texts))
    monkeypatch.setattr(bpe, "REMEMBERED", 4)  # the memory turns over at each batch
    assert codec.packed(texts) == codec.packed(texts) == first


def test_round_trip(odd, empty, library):
    want = defaultdict(list)
    for r in odd.collect():
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids
        back = library.decode(ids, skip_special_tokens=False)
        want[r["doc_id"]].append((len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()))
    got = defaultdict(list)
    for r in bpe.round_trip(odd, PATH, top=20).collect():
        got[r["doc_id"]].append(tuple(r)[1:])
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    assert bpe.round_trip(empty, PATH).count() == 0
    texts = {r["doc_id"]: r["text"] for r in bpe.decode_ids(bpe.encode_documents(odd, PATH), PATH).collect()}
    assert texts[5] == odd.where("doc_id = 5").first()["text"] and texts[0] == ""


def packed_well(rows, want, size):
    by_seq = defaultdict(list)
    for r in rows:
        by_seq[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in by_seq.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= size
    assert sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == sorted(want)
    total = sum(r["length"] for r in rows)
    return len(by_seq), -(-total // size)


def cut(doc_id, ids, size):
    ids = [*ids, 0]
    first = (len(ids) - 1) % size + 1
    at, k = 0, 0
    for stop in range(first, len(ids) + 1, size):
        yield (doc_id, k, at, stop - at, zlib.crc32(struct.pack(f"<{stop - at}I", *ids[at:stop])))
        at, k = stop, k + 1


@pytest.mark.parametrize("size", [64, 2048])
def test_packing(odd, docs, empty, library, size):
    for table, slack in ((odd, 3), (docs, 2)):
        rows = packing.pack_documents(table, PATH, size).collect()
        want = [p for r in table.collect() for p in cut(r["doc_id"] if r["doc_id"] is not None else -1, library.encode(r["text"] or "", add_special_tokens=False).ids, size)]
        used, least = packed_well(rows, want, size)
        assert used <= least * 1.01 + slack
    assert packing.pack_documents(empty, PATH, size).count() == 0


def test_plan_places_every_rank_once():
    rng = np.random.default_rng(5)
    for scale in (3, 50):
        count = np.zeros(257, int)
        count[1:] = rng.poisson(scale * rng.random(256))
        steps = packing.plan(count)
        filled = defaultdict(int)
        for length in range(1, 257):
            own = steps["length"] == length
            ranks = sorted(r for lo, n in zip(steps["lo"][own], steps["n"][own], strict=True) for r in range(lo, lo + n))
            assert ranks == list(range(count[length]))
        for length, _, n, copies, sequence, _ in zip(*steps.values(), strict=True):
            for k in range(n):
                filled[sequence + k // copies] += length
        assert max(filled.values()) <= 256
        assert len(filled) <= -(-int((count * np.arange(257)).sum()) // 256) * 1.03 + 1


def test_special_tokens_come_from_the_file():
    with open(PATH) as f:
        assert bpe.vocabulary(PATH).special == {t["content"]: t["id"] for t in json.load(f)["added_tokens"]}
