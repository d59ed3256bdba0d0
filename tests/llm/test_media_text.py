import base64
import hashlib
import re
import struct
import zlib
from collections import Counter

import numpy as np
import pytest

from chunkframe.llm import language, licenses, spots, tiff, toxicity


@pytest.mark.parametrize("compression", [tiff.NONE, tiff.PACKBITS, tiff.LZW, tiff.DEFLATE])
@pytest.mark.parametrize("form", [{}, {"tile": 32}, {"rows": 7, "predictor": 2}, {"order": ">"}])
def test_tiff_pages_round_trip(compression, form):
    rng = np.random.default_rng(2)
    images = [rng.integers(0, 4, (50, 70)).astype(np.uint8), np.zeros((3, 300), np.uint8), rng.integers(0, 256, (90, 90)).astype(np.uint8), np.repeat(rng.integers(0, 256, (9, 9)).astype(np.uint8), 20, axis=1)]
    got = list(tiff.pages(tiff.write_grey(images, compression, **form)))
    assert len(got) == 4
    for p, image in zip(got, images, strict=True):
        assert np.array_equal(p.pixels[:, :, 0], image) and p.compression == compression


def test_lzw_long_input():
    data = bytes(np.random.default_rng(1).integers(0, 256, 30_000).astype(np.uint8)) + b"ab" * 20_000
    assert tiff.lzw_decode(tiff.lzw_encode(data), len(data)) == data


def test_tiff_table_reports_broken_files(spark):
    good = tiff.write_grey([np.ones((2, 4), np.uint8)] * 2)
    rows = tiff.tiff_pages(spark.createDataFrame([(1, bytearray(good)), (2, bytearray(b"II*\0junk")), (3, None)], "doc_id long, media binary")).collect()
    assert [(r["doc_id"], r["page"]) for r in rows if r["error"] is None] == [(1, 0), (1, 1)]
    assert {r["doc_id"] for r in rows if r["error"]} == {2, 3}


def test_hostile_files_are_errors_not_crashes(spark):
    good = tiff.write_grey([np.arange(12, dtype=np.uint8).reshape(3, 4)], tiff.NONE)

    def with_tag(tag, value):
        data = bytearray(good)
        at = struct.unpack_from("<I", data, 4)[0]
        for e in range(at + 2, at + 2 + 12 * struct.unpack_from("<H", data, at)[0], 12):
            if struct.unpack_from("<H", data, e)[0] == tag:
                struct.pack_into("<I", data, e + 8, value)
        return data

    files = [with_tag(t, v) for t in (tiff.WIDTH, tiff.HEIGHT, tiff.ROWS, tiff.SAMPLES, tiff.OFFSETS, tiff.COUNTS) for v in (0, 2**31)]
    rows = tiff.tiff_pages(spark.createDataFrame(list(enumerate(files)), "doc_id long, media binary")).collect()
    assert {r["doc_id"] for r in rows if r["error"]} >= {0, 1, 2, 3, 4, 6, 7, 9, 10} and len(rows) == len(files)
    assert tiff.expand(zlib.compress(bytes(10**7)), tiff.DEFLATE, 100) == bytes(100)


def test_text_payloads(odd, empty):
    text = {}
    for r in odd.collect():
        text.setdefault(r["doc_id"], r["text"] or "")
    for r in tiff.payload_digests(tiff.text_files(odd)).collect():
        raw = text[r["doc_id"]].encode()
        whole = raw + b"\xff" * ((-len(raw)) % 576 if raw else 576)
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(whole), hashlib.sha256(whole).hexdigest(), zlib.crc32(whole[-32:]))
    files = {r["doc_id"]: bytes(r["media"]) for r in tiff.text_files(odd.where("doc_id <> 7")).collect()}
    pages = {}
    for r in tiff.tiff_pages(tiff.text_files(odd.where("doc_id <> 7"))).collect():
        pages.setdefault(r["doc_id"], {})[r["page"]] = (r["compression"], bytes(r["pixels"]), r["feature"])
    assert {k: [p[0] for _, p in sorted(v.items())] for k, v in pages.items()}[6] == [tiff.LZW, tiff.PACKBITS, tiff.DEFLATE]
    for r in tiff.payload_digests(tiff.text_files(odd.where("doc_id <> 7"))).collect():
        mine = [p for _, p in sorted(pages[r["doc_id"]].items())]
        assert r["media_bytes"] == len(files[r["doc_id"]]) and r["media_sha256"] == hashlib.sha256(files[r["doc_id"]]).hexdigest()
        assert r["feature"] == "|".join(p[2] for p in mine) and r["payload_sha256"] == hashlib.sha256(b"".join(p[1] for p in mine)).hexdigest()
    assert tiff.payload_digests(tiff.text_files(empty)).count() == 0


def test_spots_against_brute_force(odd, docs, empty):
    for table in (odd, docs):
        rows = [(r["doc_id"], r["text"]) for r in table.collect()]
        rows.sort(key=lambda r: (r[0] is None, -(r[0] or 0), tuple(-ord(c) for c in r[1] or "") + (1,)))
        want = {}
        for (i, t), (_, u) in zip(rows, rows[1:] + rows[:1], strict=True):
            t, u = t or "", u or ""
            edited = t[: len(t) - len(t) // 2] + u[: len(t) // 2]
            a, b, c = (set(spots.spots(x).tolist()) for x in (t, edited, u))
            want.setdefault(i, []).append((len(t), hashlib.sha256(edited.encode()).hexdigest(), len(a & b) / len(a | b), len(a & c) / len(a | c)))
        got = {}
        for r in spots.fingerprint_edits(table).collect():
            got.setdefault(r["doc_id"], []).append((r["n_chars"], r["edited_sha256"], r["near_edited"], r["near_next"]))
        assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    assert spots.fingerprint_edits(empty).count() == 0


def test_spots_of_equal_and_near_texts():
    a = "the cat sat on the mat and the dog ran to the house of a friend with big ears"
    assert spots.fingerprint(spots.spots(a)) == spots.fingerprint(spots.spots(a))
    assert spots.jaccard(spots.spots(a), spots.spots(a.replace("big", "small"))) > 0.5
    assert spots.jaccard(np.arange(3), np.arange(10), 0.8) == 0.0
    assert spots.jaccard(spots.spots("!!"), spots.spots("??")) == 0.0 and spots.jaccard(spots.spots(None), spots.spots("")) == 1.0


def test_fingerprints_name_their_spots(docs):
    rows = {r["doc_id"]: r for r in spots.fingerprint_edits(docs).collect()}
    for r in docs.collect():
        found = sorted(set(spots.spots(r["text"]).tolist()))
        assert rows[r["doc_id"]]["fingerprint"] == f"{len(found)}:" + base64.b64encode(struct.pack(f"<{len(found)}I", *found)).decode()


def test_near_classes_equal_brute_force(spark, docs, odd, empty):
    for table in (docs, odd):
        rows = [(r["doc_id"], set(spots.mixed_spots(r["text"]).tolist())) for r in table.select("doc_id", "text").collect()]
        group = list(range(len(rows)))
        for i, (_, a) in enumerate(rows):
            for j, (_, b) in enumerate(rows[:i]):
                if 100 * len(a & b) >= 80 * len(a | b) and group[i] != group[j]:
                    group = [group[j] if g == group[i] else g for g in group]
        least = {g: min((d for (d, _), h in zip(rows, group, strict=True) if h == g and d is not None), default=None) for g in set(group)}
        want = Counter((d, len(s), least[g]) for (d, s), g in zip(rows, group, strict=True))
        assert Counter(tuple(r) for r in spots.near_classes(table).collect()) == want
    assert spots.near_classes(empty).count() == 0


def test_letters_only():
    for text in ("½", "² ³", "Ⅻ", "12_34", "\u0301"):
        assert not len(language.gram_counts(text)[0]), text
    assert len(language.gram_counts("a\u0301b")[0]) == 3


def test_language_on_held_out_rows(docs, odd, empty):
    rows = language.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r["lang_pred"] == r["lang"] for r in rows) >= 0.95 * len(rows)
    got = {r["doc_id"]: r for r in language.identify(odd).collect()}
    assert {got[i]["lang_pred"] for i in (0, 1, 2, 11)} == {"und"} and got[0]["score"] == 0.0
    assert got[3]["lang_pred"] in ("en", "de") and all(0 <= r["score"] <= 1 for r in got.values())
    assert language.identify(empty).count() == 0
    assert {r["lang_pred"] for r in language.identify(odd.where("lang is null")).collect()} == {"und"}


def test_toxicity_on_held_out_rows(spark, odd, empty):
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    rows = toxicity.toxicity(docs, labels).join(labels, "doc_id").where("held_out").collect()
    assert sum(r["predicted"] == r["toxic"] for r in rows) >= 0.92 * len(rows)
    assert all(0 <= r["score"] <= 1 for r in rows)
    none = toxicity.toxicity(odd, spark.createDataFrame([], "doc_id long, quality int, toxic int")).collect()
    assert {r["score"] for r in none} == {0.0} and len(none) == odd.count()
    assert toxicity.toxicity(empty, labels).count() == 0
    assert toxicity.toxicity(odd, spark.createDataFrame([(6, 1, 1), (7, 1, 0), (8, 1, 0), (3, None, None)], "doc_id long, quality int, toxic int")).count() == odd.count()


def test_toxicity_learns_beyond_its_start(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    rows = [(r["doc_id"], r["text"] or "", r["toxic"]) for r in docs.join(labels, "doc_id").where("toxic is not null").orderBy("doc_id").collect()]
    out = [(t, y) for d, t, y in rows if zlib.crc32(str(d).encode()) % 5 == 0]
    for seed in (1, 2):
        some = [rows[i] for i in np.random.default_rng(seed).permutation(len(rows)) if zlib.crc32(str(rows[i][0]).encode()) % 5]
        some = [r for r in some if r[2]][:1000] + [r for r in some if not r[2]][:1000]
        right = lambda **kw: np.mean([(s >= 0.5) == y for s, (_, y) in zip(toxicity.Scorer(toxicity.fit([r[1] for r in some], [r[2] for r in some], seed=seed, **kw))([t for t, _ in out]), out, strict=True)])  # noqa: B023, E731
        assert right() > right(epochs=0) + 0.01 and right(telling_start=False, rate=0.2) > 0.9


def test_score_is_that_of_the_worst_window():
    rng = np.random.default_rng(4)
    model = rng.normal(0, 1, toxicity.BUCKETS + 1)
    for text in ("", "one", "a few words", "You worthless idiot, said the man of the house to the dog and went away", "x" * 90 + " y"):
        words = toxicity.words_of(text)
        of = [np.mean([model[b] for b in toxicity.subwords(w)]) for w in words]
        windows = [of[i : i + 4] for i in range(max(1, len(of) - 3))]
        worst = max(sum(w) / len(w) for w in windows) if of else 0.0
        assert np.isclose(toxicity.Scorer(model)([text])[0], 1 / (1 + np.exp(-(worst + model[-1]))))


def test_toxicity_reads_a_chunk_once(monkeypatch):
    read, words_of = [], toxicity.words_of
    monkeypatch.setattr(toxicity, "words_of", lambda t: read.append(len(t or "")) or words_of(t))
    score = toxicity.Scorer(np.random.default_rng(2).normal(0, 1, toxicity.BUCKETS + 1))
    texts = [f"Nr. {k}: Größe, é漢字😀\u2003" + "noch mehr; viel-mehr Σας " * 60 + "x" * 90 for k in range(30)] + ["", None, "...", "Ein"]
    first = score(texts)
    assert sum(read) < 1000
    assert first == [score([t])[0] for t in texts]
    monkeypatch.setattr(toxicity, "REMEMBERED", 4)  # the memory turns over at each batch
    assert score(texts) == score(texts) == first
    words = sorted({w for t in texts for w in words_of(t)})
    bucket, of = toxicity.subwords_of_all(words, score.steps)
    assert all(bucket[of == i].tolist() == toxicity.subwords(w) for i, w in enumerate(words))


def test_toxicity_sees_every_place():
    clean = [f"the {a} of the {b} is near a {c}" for a in ("house", "garden", "river") for b in ("friend", "teacher", "city") for c in ("tree", "road", "hill")]
    toxic = [f"you worthless idiot said the {a} of the {b}" for a in ("house", "garden", "river") for b in ("friend", "teacher", "city")]
    score = toxicity.Scorer(toxicity.fit(clean + toxic, [0] * len(clean) + [1] * len(toxic)))
    fill = "the house of the friend is near a road".split()
    at = score([" ".join(fill[:k] + ["worthless", "idiot"] + fill[k:]) for k in range(3, 7)])
    assert min(at) > 0.5 > score([" ".join(fill)])[0] and max(at) - min(at) < 0.2
    same = score([" ".join(["xyzzy"] * k + ["near", "worthless", "idiot", "near"] + ["xyzzy"] * 8) for k in range(4, 8)])
    assert len(set(same)) == 1
    plain = "houseofthefriend" * 4
    assert score([plain + "worthlessidiot"])[0] > 0.5 > score([plain])[0]
    assert score([plain + "worthlessidiot" + plain])[0] > 0.5
    for n in (41, 42, 43, 44, 45, 400):
        run = "".join(chr(0x4E00 + i) for i in range(n))
        assert set(run) <= set("".join(toxicity.words_of(run)))


def test_license_spans(odd, docs, empty):
    index = licenses.Index()
    text = "Foo bar.\nThis work is licensed under the GNU General Public License, version 3.\nMore words."
    (m,) = index.scan(text)
    assert m[0] == "GPL-3.0" and m[1] == 1.0 and text[m[3] : m[4]] == "This work is licensed under the GNU General Public License, version 3"
    for name, template in licenses.TEMPLATES.items():
        found = index.scan(f"x y z {template} a b c {template}")
        assert [f[1] for f in found if f[0] == name] == [1.0, 1.0], name
        words = template.split()
        if len(words) > 20:
            del words[10:12]
            words.insert(15, "inserted")
            assert [f[0] for f in index.scan(" ".join(words)) if f[0] == name] == [name]
    assert index.scan(None) == [] and index.scan("") == [] and index.scan("MIT") == []
    rows = licenses.scan_licenses(docs).collect()
    plain = {(r["doc_id"], n) for r in docs.collect() for n in ("Apache-2.0", "MIT", "GPL-3.0", "CC-BY-NC-4.0") if licenses.TEMPLATES[n] in (r["text"] or "")}
    assert plain <= {(r["doc_id"], r["template"]) for r in rows}
    assert [r["template"] for r in licenses.scan_licenses(odd).collect()] == ["Apache-2.0"]
    assert licenses.scan_licenses(empty).count() == 0


def test_licenses_equal_brute_force(docs):
    """Both ways: every match stands up to a plain alignment, and wherever a plain alignment holds, a match lies over it."""
    index, word = licenses.Index(), re.compile(r"[^\W_]+")
    templates = {n: word.findall(t.lower()) for n, t in licenses.TEMPLATES.items()}

    def common(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
            row = new
        return row[-1]

    seen = 0
    for r in docs.where("text is not null").collect():
        ws = word.findall(r["text"].lower())
        spans = [m.span() for m in word.finditer(r["text"].lower())]
        found = index.scan(r["text"])
        for name, coverage, matched, a, b in found:
            inside = [w for w, (p, q) in zip(ws, spans, strict=True) if p >= a and q <= b]
            assert common(templates[name], inside) >= matched >= 0.7 * len(templates[name]) and np.isclose(coverage, matched / len(templates[name]), atol=1e-6)
            seen += 1
        for name, t in templates.items():
            have = np.array([w in set(t) for w in ws], int)
            sums = np.convolve(have, np.ones(len(t), int))[len(t) - 1 :] if len(ws) else have
            for i in np.nonzero(sums >= 0.7 * len(t))[0].tolist():
                window = ws[i : i + len(t)]
                if common(t, window) >= 0.7 * len(t) and all(f" {p} " in f" {' '.join(window)} " for p in licenses.TELLING.get(name, [])):
                    assert any(a < spans[min(i + len(t), len(ws)) - 1][1] and b > spans[i][0] for _, _, _, a, b in found), (r["doc_id"], name)
    assert seen


def test_sibling_licenses_are_told_apart():
    names = lambda text: [f[0] for f in licenses.Index().scan(f"Some words first. {text} And more of them.")]
    for name, template in licenses.TEMPLATES.items():
        assert names(template) == [name]
    gpl3, gpl2 = licenses.TEMPLATES["GPL-3.0-notice"], licenses.TEMPLATES["GPL-2.0-notice"]
    assert names(gpl3.replace("version 3", "version 2")) == ["GPL-2.0-notice"] and names(gpl2.replace("version 2", "version 4")) == []
    assert names("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.") == ["CC-BY-SA-4.0-notice"]
    assert names("This work is licensed under a Creative Commons Attribution 3.0 International License.") == []
    assert names("Licensed under the Apache License, Version 1.1.") == ["Apache-1.1"] and names("Licensed under the Apache License, Version 1.0.") == []
    assert names("Licensed under CC BY 4.0.") == ["CC-BY-4.0-line"] and names("Licensed under CC BY-NC 3.0.") == []
    bsd = licenses.TEMPLATES["BSD-3-Clause"].replace("3. Neither", "* Neither").replace("the copyright holder nor", "Foo Inc nor")
    assert names(bsd) == ["BSD-3-Clause"]


def test_whole_licenses_are_matched_over_their_whole_span():
    index = licenses.Index()
    for name in ("GPL-3-whole", "Apache-2.0-whole", "LGPL-2.1-whole", "MPL-2.0-whole", "LGPL-3-whole"):
        text = licenses.WHOLE[name]
        before = "Some words first. " * 30
        (match,) = index.scan(before + text + " And more.")
        assert match[0] == name and match[1] == 1.0 and match[4] - match[3] > 0.99 * len(text.strip()) and match[3] >= len(before)
        words = text.split()
        for i in range(0, len(words), 40):
            words[i] = "changed"
        del words[len(words) // 2 : len(words) // 2 + 10]
        (match,) = index.scan(" ".join(words))
        assert match[0] == name and 0.9 < match[1] < 1.0 and match[4] - match[3] > 0.8 * len(" ".join(words))
    twice = index.scan(licenses.WHOLE["CC0-1.0-whole"] + " and again " + licenses.WHOLE["CC0-1.0-whole"])
    assert [m[0] for m in twice] == ["CC0-1.0-whole"] * 2 and twice[0][4] < twice[1][3]
    half = licenses.WHOLE["GPL-2-whole"]
    assert "GPL-2-whole" not in [m[0] for m in index.scan(half[: len(half) // 2])]  # below the share that counts


def test_both_alignments_agree():
    rng = np.random.default_rng(1)
    for _ in range(300):
        template, text = (rng.integers(0, 9, rng.integers(1, n)).astype(np.uint64) for n in (30, 50))
        diagonal, band = int(rng.integers(-5, 20)), int(rng.integers(1, 9))
        assert licenses.align(template, text, diagonal, band) == licenses.align_long(template, text, diagonal, band)


def brute_language(docs_rows):
    """Prototypes and cosines written out: letters, n-grams, sums, one at a time."""
    import unicodedata
    import zlib as z

    letters = {}

    def letter(c):
        if c not in letters:
            letters[c] = np.random.default_rng(c + 1).choice(np.array([-1, 1], np.int8), language.DIMENSIONS).astype(int)
        return letters[c]

    grams = {}

    def vector(text):
        kept = "".join(c if unicodedata.category(c)[0] in "LM" else " " for c in (text or "").lower())
        kept = " ".join(kept.split())
        if not any(unicodedata.category(c)[0] == "L" for c in kept):
            return None
        line, total = f" {kept} ", np.zeros(language.DIMENSIONS)
        for i in range(len(line) - 2):
            g = line[i : i + 3]
            if g not in grams:
                grams[g] = np.roll(letter(ord(g[0])), 0) * np.roll(letter(ord(g[1])), 1) * np.roll(letter(ord(g[2])), 2)
            total += grams[g]
        return total / np.linalg.norm(total) if np.linalg.norm(total) else total

    sums = {}
    for doc_id, text, lang in docs_rows:
        v = vector(text)
        if v is not None and lang is not None and z.crc32(str(doc_id).encode()) % 5 != 0:
            sums[lang] = sums.get(lang, 0) + v
    prototypes = {n: v / np.linalg.norm(v) for n, v in sums.items()}
    out = {}
    for doc_id, text, _ in docs_rows:
        v = vector(text)
        scores = {} if v is None else {n: float(v @ p) for n, p in prototypes.items()}
        out[doc_id] = scores
    return out


def test_language_equals_a_second_way(docs):
    rows = [(r["doc_id"], r["text"], r["lang"]) for r in docs.select("doc_id", "text", "lang").collect()]
    want = brute_language(rows)
    for r in language.identify(docs).collect():
        scores = want[r["doc_id"]]
        if not scores:
            assert r["lang_pred"] == "und" and r["score"] == 0
        else:
            assert abs(max(scores.values()) - scores[r["lang_pred"]]) < 1e-4 and abs(r["score"] - max(0.0, min(1.0, scores[r["lang_pred"]]))) < 1e-4


def spots_in_words(text):
    """Spots as tuples of words, found word by word."""
    words = re.findall(r"[^\W_]+", (text or "").lower())
    out = set()
    for i, w in enumerate(words):
        if w in spots.ANCHORS:
            chain = [v for v in words[i + 1 :] if v not in spots.ANCHORS][: spots.CHAIN]
            if len(chain) == spots.CHAIN:
                out.add((w, *chain))
    if not out and len(words) > spots.CHAIN:
        out = set(zip(words, words[1:], words[2:], strict=False))
    return out or ({(w,) for w in words} if words else {("", text or "")})


def test_spots_equal_a_second_way(docs, odd):
    texts = [r["text"] for r in docs.orderBy("doc_id").collect()][:120] + [r["text"] for r in odd.collect()]
    texts = [t if t is None or len(t) < 8000 else t[:8000] for t in texts]  # the second way takes a square of the length
    by_words = [spots_in_words(t) for t in texts]
    by_hash = [spots.spots(t) for t in texts]
    for a, h in zip(by_words, by_hash, strict=True):
        assert len(a) == len(h)
    for i in range(1, len(texts)):
        for j in {i - 1, i * 7 % len(texts)}:
            a, b = by_words[i], by_words[j]
            assert abs(spots.jaccard(by_hash[i], by_hash[j]) - len(a & b) / len(a | b)) < 1e-12
