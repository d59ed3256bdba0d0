"""Byte-level BPE over Spark: a minimal acyclic transducer of frequent words, exact merges for the rest.

``encode_documents`` counts the words of all texts, compiles the most frequent ones with
their ids into a shared-suffix automaton whose edge outputs add up to a word's number, ships
its bytes once, lets every Python worker memory-map them, and merges unseen words exactly.

Defined cases: null text is the empty text (0 ids); a very long text is merged word by word, and a very long word by
a heap in n log n steps; ties and repeated rows give equal rows; an empty table gives an empty result; other columns,
whatever their names, are ignored.
"""

from __future__ import annotations

import functools
import gc
import hashlib
import heapq
import json
import mmap
import re
import tempfile
from array import array
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, most_frequent, prepare, written

#: Words in the automaton, words and chunks a worker remembers of each, letters of a chunk it remembers, and words that the library reads as one text.
LEXICON_WORDS, REMEMBERED, LONGEST, JOINED = 131_072, 1_000_000, 64, 512

# The split pattern of byte_bpe_50k.json, and white space as Unicode has it.
_WS = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PATTERN = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_WS}\p{{L}}\p{{N}}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]+")
# The same for texts of Latin letters alone, where Python's faster engine can take the classes as lists.
_L, _N = r"A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f", r"0-9\xb2\xb3\xb9\xbc-\xbe"
_LATIN = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^{_WS}{_L}{_N}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]+")
_BEYOND = re.compile(r"[^\x00-\u024f\u2010-\u2027\u20ac]")
_WHITE = frozenset(chr(c) for c in range(0x3001) if re.match(f"[{_WS}]", chr(c)))
_COUNTED = regex.compile(r"[\p{L}\p{N}]")


def pretokens(text: str) -> list[str]:
    """The words that merges never cross, in order; together they are the text."""
    return (PATTERN if _BEYOND.search(text) else _LATIN).findall(text)


_ID, _NO_MERGE = (1 << 20) - 1, 1 << 62


class Vocabulary:
    """A tokenizer file: merges by pair of ids, bytes by id, special strings."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        shown = [b for r in ((33, 127), (161, 173), (174, 256)) for b in range(*r)]
        char = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(x for x in range(256) if x not in set(shown))}
        byte = {c: b for b, c in char.items()}
        vocab = spec["model"]["vocab"]
        self.first = [vocab[char[b]] for b in range(256)]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.pieces = [b""] * (max([*vocab.values(), *self.special.values()]) + 1)
        for s, i in vocab.items():
            self.pieces[i] = bytes(byte[c] for c in s)
        for s, i in self.special.items():
            self.pieces[i] = s.encode()
        self.decimal = list(map(str, range(len(self.pieces))))
        self.merges: dict[int, int] = {}  # rank, then the new id
        for rank, m in enumerate(spec["model"]["merges"]):
            a, b = m.split(" ") if isinstance(m, str) else m
            self.merges[vocab[a] << 20 | vocab[b]] = rank << 20 | vocab[a + b]
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    def merge(self, word: bytes) -> list[int]:
        """The ids of one word: the lowest-ranked pair first, as training merged them."""
        ids, get = [self.first[b] for b in word], self.merges.get
        if len(ids) > 200:
            return self._merge_long(ids)
        pairs = [get(a << 20 | b, _NO_MERGE) for a, b in zip(ids, ids[1:], strict=False)]
        while pairs and (best := min(pairs)) < _NO_MERGE:
            i = pairs.index(best)
            ids[i : i + 2] = [best & _ID]
            del pairs[i]
            if i:
                pairs[i - 1] = get(ids[i - 1] << 20 | ids[i], _NO_MERGE)
            if i < len(pairs):
                pairs[i] = get(ids[i] << 20 | ids[i + 1], _NO_MERGE)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same by a heap and a linked list, for words of any length."""
        n, merges = len(ids), self.merges
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = []

        def put(i: int) -> None:
            if i >= 0 and after[i] < n and (m := merges.get(ids[i] << 20 | ids[after[i]])) is not None:
                heapq.heappush(heap, (m >> 20, i, ids[i], ids[after[i]], m & _ID))

        for i in range(n - 1):
            put(i)
        while heap:
            _, i, a, b, new = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j], after[i] = new, -1, after[j]
            if after[j] < n:
                before[after[j]] = i
            put(i)
            put(before[i])
        return [x for x in ids if x >= 0]

    def parts(self, text: str) -> list[str]:
        """Plain stretches at even places, special strings at odd ones."""
        return self.split.split(text) if self.split and any(s in text for s in self.special) else [text]

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.pieces.__getitem__, ids)).decode("utf-8", "replace")


class Lexicon:
    """Minimal acyclic transducer over bytes; the outputs on a word's path add up to its number."""

    FIELDS = ("keys", "target", "out", "final", "starts", "ids")

    def __init__(self, buffer):
        head, at = np.frombuffer(buffer, "<i8", len(self.FIELDS)), 8 * len(self.FIELDS)
        for name, n in zip(self.FIELDS, head, strict=True):
            kind = "<i8" if name == "keys" else "<i4"
            setattr(self, name, np.frombuffer(buffer, kind, int(n), at))
            at += int(n) * (8 if name == "keys" else 4)

    @classmethod
    def mapped(cls, blob: bytes) -> "Lexicon":
        """Memory-mapped from a file that has no name and goes with the worker."""
        f = tempfile.TemporaryFile()
        f.write(blob)
        f.flush()
        return cls(mmap.mmap(f.fileno(), len(blob), access=mmap.ACCESS_READ))

    @classmethod
    def compiled(cls, words: dict[bytes, list[int]]) -> bytes:
        """The automaton of ``words`` as bytes: sorted words, equal tails registered once."""
        order = sorted(words)
        register: dict[tuple, int] = {}
        states: list[tuple[bool, list[tuple[int, int]]]] = []
        path: list[list] = [[False, []]]  # of the word being read: final, edges to finished states
        last = b""

        def finish(depth: int) -> None:
            while len(path) > depth + 1:
                final, edges = path.pop()
                key = (final, tuple(edges))
                if key not in register:
                    register[key] = len(states)
                    states.append((final, edges))
                path[-1][1].append((last[len(path) - 1], register[key]))

        for word in order:
            same = next((i for i, (a, b) in enumerate(zip(last, word, strict=False)) if a != b), min(len(last), len(word)))
            finish(same)
            path.extend([False, []] for _ in word[same:])
            path[-1][0] = True
            last = word
        finish(0)
        states.append((path[0][0], path[0][1]))
        count = []  # words below each state; edges lead to states with smaller numbers
        for final, edges in states:
            count.append(final + sum(count[t] for _, t in edges))
        root, keys, target, out = len(states) - 1, [], [], []
        name = lambda s: 0 if s == root else s + 1  # noqa: E731  the root is state 0
        for s, (final, edges) in enumerate(states):
            passed = int(final)
            for b, t in edges:
                keys.append(name(s) << 8 | b)
                target.append(name(t))
                out.append(passed)
                passed += count[t]
        sort = np.argsort(keys) if keys else np.zeros(0, int)
        final = np.zeros(len(states) + 1, "<i4")
        for s, (f, _) in enumerate(states):
            final[name(s)] = f
        starts = np.cumsum([0, *(len(words[w]) for w in order)])
        fields = (np.array(keys, "<i8")[sort], np.array(target, "<i4")[sort], np.array(out, "<i4")[sort], final, starts.astype("<i4"), np.array([i for w in order for i in words[w]], "<i4"))
        return np.array([len(x) for x in fields], "<i8").tobytes() + b"".join(x.tobytes() for x in fields)

    def find(self, words: list[bytes]) -> list[list[int] | None]:
        """The ids of each word, None for words that aren't in it; all words advance a byte at a time."""
        size = np.array([len(w) for w in words], int)
        text = np.frombuffer(b"".join(words), np.uint8)
        begin, state, number = np.cumsum(size) - size, np.zeros(len(words), int), np.zeros(len(words), int)
        alive = np.arange(len(words)) if len(self.keys) else np.zeros(0, int)
        if not len(self.keys):
            state[:] = -1
        for i in range(int(size.max(initial=0))):
            alive = alive[size[alive] > i]
            if not len(alive):
                break
            key = state[alive] << 8 | text[begin[alive] + i]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            ok = self.keys[at] == key
            state[alive[~ok]] = -1
            alive, at = alive[ok], at[ok]
            number[alive] += self.out[at]
            state[alive] = self.target[at]
        known = (state >= 0) & (self.final[np.maximum(state, 0)] > 0)
        return [self.ids[self.starts[n] : self.starts[n + 1]].tolist() if k else None for k, n in zip(known.tolist(), number.tolist(), strict=True)]


class Memory:
    """A bounded dict of two halves: when the newer one is full it becomes the older one, and what is met again moves on."""

    def __init__(self):
        self.seen, self.older = {}, {}

    def room(self) -> None:
        if len(self.seen) > REMEMBERED // 2:
            self.seen, self.older = {}, self.seen

    def again(self, key: str) -> bytes | None:
        """What the older half holds of a key that the newer one lacks."""
        found = self.older.get(key)
        if found is not None:
            self.seen[key] = found
        return found


class Chunks:
    """Texts cut where no word goes on, by Arrow: at single blanks, single new lines, and before a stop or comma behind a letter or number.

    A chunk is what follows a blank, but ``BARE`` and what follows none, or ``LINE`` for a new line. Cuts are
    only right with no other white space beside a blank or new line, and no other sign before a stop or comma; ``plain`` says of each text whether they are.
    """

    BARE, LINE = "\1", "\2"

    def __init__(self, texts: list[str]):
        cut = pa.array(texts, pa.large_string())
        for sign, to in ((".", " \1."), (",", " \1,"), ("\n", " \2 \1")):
            cut = pc.replace_substring(cut, sign, to)
        cut = pc.split_pattern(cut, " ")
        self.bounds, coded = cut.offsets.to_numpy(), cut.flatten().dictionary_encode()
        self.indices, self.at = coded.indices, coded.indices.to_numpy()
        self.names = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        _, offsets, data = coded.dictionary.buffers()
        ends = np.frombuffer(offsets, np.int64)[: len(self.names) + 1]
        data = np.frombuffer(data or b"", np.uint8)
        size = np.diff(ends)
        byte = lambda i, least: np.where(size >= least, data[np.minimum(np.maximum(i, 0), len(data) - 1)], 0) if len(data) else np.zeros(len(size), np.uint8)
        first, second, last = byte(ends[:-1], 1), byte(ends[:-1] + 1, 2), byte(ends[1:] - 1, 1)
        stop, line = (first == 1) & np.isin(second, (44, 46)), (first == 2) & (size == 1)
        counted = ((last >= 48) & (last <= 57)) | ((last | 32) >= 97) & ((last | 32) <= 122) & (last < 128)
        for k in np.nonzero(last >= 128)[0].tolist():
            counted[k] = ends_counted(self.names[k][-1])
        self.odd = (size == 0) | (first == 1) & (size == 1) | (first == 2) & (size > 1)
        before = np.concatenate((self.at[:1], self.at[:-1]))
        wrong = (stop[self.at] & ~counted[before]) | (((first == 1) & ~stop)[self.at] & ~line[before])
        wrong[self.bounds[:-1][self.bounds[:-1] < len(wrong)]] = False  # a text's first chunk is read apart
        self.wrong = wrong

    def text(self, k: int) -> str:
        name = self.names[k]
        return name[1:] if name[0] == self.BARE else "\n" if name == self.LINE else " " + name

    def plain(self) -> np.ndarray:
        """Whether a text's chunks are all as they should be; ``odd`` is known by then."""
        n = np.concatenate(([0], np.cumsum(self.wrong | self.odd[self.at])))
        return n[self.bounds[1:]] == n[self.bounds[:-1]]


@functools.cache
def ends_counted(sign: str) -> bool:
    return bool(_COUNTED.match(sign))


def edged(chunk: str) -> bool:
    """Whether a chunk begins or ends with white space."""
    return chunk[0] in _WHITE or chunk[-1] in _WHITE or (chunk[0] == Chunks.BARE and chunk[1] in _WHITE)


class WordCodec:
    """Texts to packed ids through bounded memories of words, and of what stands between single blanks; ``ids_of`` gives the packed ids of words it has not met."""

    def __init__(self, vocab: Vocabulary, ids_of):
        self.vocab, self.ids_of, self.words, self.chunks = vocab, ids_of, Memory(), Memory()
        self.special = {s: array("I", [i]).tobytes() for s, i in vocab.special.items()}

    def packed(self, texts: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each text; nothing here makes cycles, so their collector can wait."""
        was = gc.isenabled()
        gc.disable()
        try:
            return self._packed(texts)
        finally:
            if was:
                gc.enable()

    def _packed(self, texts: list[str]) -> list[bytes]:
        """Each chunk of the batch is looked up once. Texts with special strings, or that ``Chunks`` can't cut, are read word by word."""
        self.chunks.room()
        cut, seen, new = Chunks(texts), self.chunks.seen, []
        names = cut.names
        packed: list = list(map(seen.get, names))
        for k in [k for k, p in enumerate(packed) if p is None]:
            if cut.odd[k] or edged(names[k]) and names[k] != cut.LINE:
                cut.odd[k], packed[k] = True, b""
            elif (p := self.chunks.again(names[k])) is None:
                new.append(k)
            else:
                packed[k] = p
        never = (*self.special, cut.BARE, cut.LINE)
        plain = [ok and not any(map(t.__contains__, never)) for t, ok in zip(texts, cut.plain().tolist(), strict=True)]
        parts = [[names[cut.at[b]]] if ok else self.vocab.parts(t) for t, ok, b in zip(texts, plain, cut.bounds[:-1].tolist(), strict=True)]  # of a plain text its first chunk, which has no blank
        for k, ids in zip(new, self._new([cut.text(k) for k in new]), strict=True):
            packed[k] = ids
            if len(names[k]) <= LONGEST:
                seen[names[k]] = ids
        ids = iter(self._known([q for p in parts for q in p[::2]]))
        taken = pa.array(packed, pa.large_binary()).take(cut.indices)
        offsets, data = np.frombuffer(taken.buffers()[1], np.int64), memoryview(taken.buffers()[2] or b"")
        out = []
        for p, ok, a, b in zip(parts, plain, offsets[np.minimum(cut.bounds[:-1] + 1, cut.bounds[1:])].tolist(), offsets[cut.bounds[1:]].tolist(), strict=True):
            start = b"".join([self.special[q] if i % 2 else next(ids) for i, q in enumerate(p)])
            out.append(b"".join((start, data[a:b])) if ok else start)
        return out

    def _new(self, chunks: list[str]) -> list[bytes]:
        """The packed ids of chunks; most are one word that was not met before."""
        split = [(c,) if c[1:].isalpha() and c.isascii() else pretokens(c) for c in chunks]
        words = sorted(set().union(*split))  # neighbours share merges
        found = dict(zip(words, self.ids_of(words), strict=True))
        return [found[w[0]] if len(w) == 1 else b"".join(map(found.__getitem__, w)) for w in split]

    def _known(self, parts: list[str]) -> list[bytes]:
        """The packed ids of parts of texts, whose words are remembered."""
        self.words.room()
        split, seen = list(map(pretokens, parts)), self.words.seen
        new = [w for w in set().union(*split).difference(seen) if self.words.again(w) is None]
        seen.update(zip(new, self.ids_of(new), strict=True))
        return [b"".join(map(seen.__getitem__, words)) for words in split]


_workers: dict = {}


def vocabulary(path: str) -> Vocabulary:
    if path not in _workers:
        _workers[path] = Vocabulary(path)
    return _workers[path]


def by_lexicon(path: str, blob: bytes) -> WordCodec:
    """This worker's codec over the mapped automaton."""
    key = (path, hashlib.sha256(blob).digest())
    if key not in _workers:
        vocab, lexicon = vocabulary(path), Lexicon.mapped(blob)

        def ids_of(words: list[str]) -> list[list[int]]:
            raw = [w.encode() for w in words]
            return [array("I", ids if ids is not None else vocab.merge(w)).tobytes() for w, ids in zip(raw, lexicon.find(raw), strict=True)]

        _workers[key] = WordCodec(vocab, ids_of)
    return _workers[key]


def by_library(path: str) -> WordCodec:
    """A codec whose unseen words go through the tokenizers library."""
    key = (path, "library")
    if key not in _workers:
        import os

        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        t = Tokenizer.from_file(path)
        t.no_truncation()
        t.no_padding()
        run = getattr(t, "encode_batch_fast", t.encode_batch)

        blank = np.array([piece.startswith(b" ") for piece in vocabulary(path).pieces])

        def ids_of(words: list[str]) -> list[bytes]:
            """Words with a blank in front go many at a time: no merge crosses a blank behind a sign that is none."""
            out = [b""] * len(words)
            plain = [i for i, w in enumerate(words) if len(w) > 1 and w[0] == " " and not w[1].isspace() and not w[-1].isspace()]
            groups = [plain[i : i + JOINED] for i in range(0, len(plain), JOINED)]
            alone = list(set(range(len(words))).difference(plain))
            for group, e in zip(groups, run(["".join([words[i] for i in g]) for g in groups], add_special_tokens=False), strict=True):
                ids = np.array(e.ids, "<u4")
                data, cuts = ids.tobytes(), [*(4 * np.nonzero(blank[ids])[0]).tolist(), 4 * len(ids)]  # a word's only blank starts its first piece
                for i, a, b in zip(group, cuts[:-1], cuts[1:], strict=True):
                    out[i] = data[a:b]
            for i, e in zip(alone, run([words[i] for i in alone], add_special_tokens=False), strict=True):
                out[i] = array("I", e.ids).tobytes()
            return out

        _workers[key] = WordCodec(vocabulary(path), ids_of)
    return _workers[key]


def frequent_words(docs: DataFrame, path: str, top: int = LEXICON_WORDS) -> list[str]:
    """The most frequent words of all texts, at most ``top``."""

    def count(batches):
        c: Counter = Counter()

        def told():
            return pa.RecordBatch.from_pydict({"word": pa.array(list(c), pa.string()), "n": pa.array(list(c.values()), pa.int64())})

        for b in batches:
            for text in b.column(0).to_pylist():
                for part in vocabulary(path).parts(text or "")[::2]:
                    c.update(pretokens(part))
            if len(c) > REMEMBERED // 4:
                yield told()
                c.clear()
        yield told()

    prepare(docs.sparkSession)
    counts = docs.select("text").mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return [w for w, _ in most_frequent(written(counts, "words"), top)]


def compile_lexicon(docs: DataFrame, path: str, top: int = LEXICON_WORDS) -> bytes:
    vocab = vocabulary(path)
    return Lexicon.compiled({w.encode(): vocab.merge(w.encode()) for w in frequent_words(docs, path, top)})


def encode_documents(docs: DataFrame, path: str, top: int = LEXICON_WORDS) -> DataFrame:
    """(doc_id, ids array<int>) of every text."""
    blob = docs.sparkSession.sparkContext.broadcast(compile_lexicon(docs, path, top))  # at most ``top`` words

    def run(x):
        packed = by_lexicon(path, blob.value).packed([t or "" for t in x["text"]])
        return {"doc_id": x["doc_id"], "ids": [np.frombuffer(p, "<u4").astype("<i4") for p in packed]}

    return arrow_map(docs.select("doc_id", "text"), run, "doc_id long, ids array<int>")


def decode_ids(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) of (doc_id, ids)."""
    return arrow_map(encoded.select("doc_id", "ids"), lambda x: {"doc_id": x["doc_id"], "text": [vocabulary(path).decode(i or []) for i in x["ids"]]}, "doc_id long, text string")


def round_trip(docs: DataFrame, path: str, top: int = LEXICON_WORDS) -> DataFrame:
    """Digests of every text's ids and of what they decode to."""
    blob = docs.sparkSession.sparkContext.broadcast(compile_lexicon(docs, path, top))  # at most ``top`` words

    def run(x):
        codec, out = by_lexicon(path, blob.value), {k: [] for k in ("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")}
        for doc_id, packed in zip(x["doc_id"], codec.packed([t or "" for t in x["text"]]), strict=True):
            ids = np.frombuffer(packed, "<u4").tolist()
            out["doc_id"].append(doc_id)
            out["n_tokens"].append(len(ids))
            out["ids_sha256"].append(hashlib.sha256(",".join(map(codec.vocab.decimal.__getitem__, ids)).encode()).hexdigest())
            out["decoded_sha256"].append(hashlib.sha256(codec.vocab.decode(ids).encode()).hexdigest())
        return out

    return arrow_map(docs.select("doc_id", "text"), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
