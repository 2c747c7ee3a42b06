"""BPE encoding and decoding by speculation and verification.

Greedy longest match proposes the tokens of every word. A sequence of tokens is the result of the merges exactly if no
merge crosses the border of any two neighbours before the pieces at that border are merged away; vectorised checks test
this for all neighbouring pairs of a batch at once, and only words with a failing pair are merged step by step.

Python's tables of letters and of lower case and those of the tokenizers library are of different versions of Unicode; they
agree on all code points that Python's have. Chunks with any other are lower-cased and split by the library.

Text is handled by white-space chunk, since no token spans white space; encoded chunks are kept in a bounded cache.
Null and empty texts have no tokens. Ids are packed as little-endian unsigned 32-bit integers in a binary column.
Repeated rows give repeated results, and other columns pass through (a column named like the output is replaced).
"""

from __future__ import annotations

import functools
import heapq
import json
import unicodedata
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from tokenizers import Regex, normalizers, pre_tokenizers

from scrivano.llm.store import claim, small_batches

#: Largest vocabulary file that is sent to the executors, and most chunks that a worker's cache holds before it starts anew.
MAX_VOCABULARY_BYTES, CACHED_CHUNKS = 64 << 20, 300_000
#: Letters that are split at once, and chunks that are learned at once.
AT_ONCE, LEARNED = 1 << 20, 1 << 15
#: Words of more bytes are merged with a heap. NEVER: later than any rank.
SHORT = 48
#: U+001C to U+001F separate words for str.split, but not for the vocabulary's patterns.
UNSPACED, UNSPACED_RARE = regex.compile(r"[^\S\x1c-\x1f]+"), regex.compile(r"[\x1c-\x1f]")
NEVER = 1 << 40


def byte_letters() -> dict[int, str]:
    """The printable letter that byte-level vocabularies write for each byte: itself where printable, else from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(0x100 + i) for i, b in enumerate(rest)}


@functools.cache
def _unassigned() -> np.ndarray:
    """For each code point, whether Python's tables do not have it."""
    return np.fromiter((unicodedata.category(chr(i)) == "Cn" for i in range(0x110000)), bool, 0x110000)


def is_odd(text: str) -> bool:
    """Whether a text has a code point that Python's tables do not have."""
    return not text.isascii() and bool(_unassigned()[np.frombuffer(text.encode("utf-32-le"), "<u4")].any())


class WordBpe:
    """A byte-level BPE vocabulary with a suffix for word ends, read from the JSON of the tokenizers library.

    Inside, tokens are numbered by rank: the single bytes first, then what each merge makes.
    """

    def __init__(self, raw: bytes):
        spec = json.loads(raw)
        model = spec["model"]
        suffix, vocab = model["end_of_word_suffix"], model["vocab"]
        to_byte = {c: b for b, c in byte_letters().items()}

        def letters(token: str) -> str:
            """One letter a byte; the last byte of a word has 256 added."""
            if token.endswith(suffix) and token != suffix:
                *first, last = token[: -len(suffix)]
                return "".join(chr(to_byte[c]) for c in first) + chr(256 + to_byte[last])
            return "".join(chr(to_byte[c]) for c in token)

        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.splitter = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.words = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.normalise = normalizers.Sequence([normalizers.NFC(), normalizers.Lowercase()]).normalize_str
        self.cut = pre_tokenizers.Split(Regex(self.words.pattern), "removed", invert=True).pre_tokenize_str
        self.texts: list[bytes | None] = [None] * (max(chain(vocab.values(), self.special.values())) + 1)
        for token, i in chain(vocab.items(), self.special.items()):
            self.texts[i] = token.encode()
        base = [t for t in vocab if len(letters(t)) == 1]
        inner = {t: i for i, t in enumerate(base)}
        self.base_letters = {letters(t): i for t, i in inner.items()}
        self.first = len(base)
        self.size = n = self.first + len(model["merges"])
        self.left, self.right = np.full(n, -1), np.full(n, -1)
        self.merges: dict[int, int] = {}
        # Checks of neighbours rest on merges that use only what earlier merges have made.
        self.proper = True
        for i, (x, y) in enumerate(model["merges"], self.first):
            self.proper &= x in inner and y in inner and x + y not in inner
            inner[x + y] = i
            if not self.proper:
                raise ValueError("a merge uses what a later merge makes")
            self.left[i], self.right[i] = inner[x], inner[y]
            self.merges[inner[x] * n + inner[y]] = i
        table = np.array(sorted(self.merges.items()), np.int64)
        self.keys, self.made = table[:, 0], table[:, 1]
        self.outer = np.zeros(n, "<u4")
        self.ends = np.zeros(n, bool)
        for t, i in inner.items():
            self.outer[i], self.ends[i] = vocab[t], t.endswith(suffix) and t != suffix
        whole = np.arange(self.first, n)
        fine = self.compatible(self.left[whole], self.right[whole], whole).tolist()
        own = [True] * n
        for i, good in zip(whole.tolist(), fine):
            own[i] = good and own[self.left[i]] and own[self.right[i]]
        self.greedy = ahocorasick.Automaton()
        for t, i in inner.items():
            if own[i]:
                self.greedy.add_word(letters(t), i)
        self.greedy.make_automaton()
        self.cache: dict[str, bytes] = {}

    def compatible(self, a: np.ndarray, b: np.ndarray, within: np.ndarray | None = None) -> np.ndarray:
        """For each pair of neighbours, whether merges leave the border between them alone (within: before that rank).

        Undoes the merges of both tokens from the last to the first; at each step the two pieces at the border must have
        no merge that comes before both are merged away inside their own tokens. Equal ranks go to the leftmost pair.
        """
        a, b = a.copy(), b.copy()
        until_a = np.full(len(a), NEVER) if within is None else within.copy()
        until_b = until_a.copy()
        good, live = np.ones(len(a), bool), np.arange(len(a))
        while len(live):
            x, y = a[live], b[live]
            key = x * self.size + y
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            r = np.where(self.keys[at] == key, self.made[at], NEVER + 1)
            crossed = (r < until_a[live]) & (r <= until_b[live])
            good[live[crossed]] = False
            live = live[~crossed & ((x >= self.first) | (y >= self.first))]
            x, y = a[live], b[live]
            undo_a = x > y
            i, j = live[undo_a], live[~undo_a]
            until_a[i], a[i] = a[i], self.right[a[i]]
            until_b[j], b[j] = b[j], self.left[b[j]]
        return good

    def merge(self, word: str) -> list[int]:
        """The exact merges of a word in letters: always the lowest rank, of equal ones the leftmost."""
        ids, n, get = [self.base_letters[c] for c in word], self.size, self.merges.get
        ranks = [get(x * n + y, NEVER) for x, y in zip(ids, ids[1:])]
        if len(ids) > SHORT:
            return self.merge_long(ids, ranks)
        while ranks and (m := min(ranks)) < NEVER:
            i = ranks.index(m)
            ids[i] = m
            del ids[i + 1], ranks[i]
            if i < len(ranks):
                ranks[i] = get(m * n + ids[i + 1], NEVER)
            if i:
                ranks[i - 1] = get(ids[i - 1] * n + m, NEVER)
        return ids

    def merge_long(self, ids: list[int], ranks: list[int]) -> list[int]:
        """The same with a heap, for words of any length."""
        n, get = self.size, self.merges.get
        after, before = [*range(1, len(ids)), -1], [*range(-1, len(ids) - 1)]
        heap = [(m, i) for i, m in enumerate(ranks) if m < NEVER]
        heapq.heapify(heap)
        while heap:
            m, i = heapq.heappop(heap)
            j = after[i]
            if j < 0 or ids[i] < 0 or get(ids[i] * n + ids[j]) != m:
                continue
            ids[i], ids[j] = m, -1
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
                if (r := get(m * n + ids[k])) is not None:
                    heapq.heappush(heap, (r, i))
            if (k := before[i]) >= 0 and (r := get(ids[k] * n + m)) is not None:
                heapq.heappush(heap, (r, k))
        return [t for t in ids if t >= 0]

    def encode_words(self, words: list[str]) -> tuple[bytes, list[int]]:
        """Packed ids of words in letters, and where in them each word starts and the last one ends."""
        flat = np.fromiter((t for _, t in self.greedy.iter_long("".join(words))), np.int64)
        stops = np.flatnonzero(self.ends[flat]) + 1
        starts = np.concatenate([[0], stops[:-1]])
        inner = np.flatnonzero(~self.ends[flat[:-1]])
        key, back = np.unique(flat[inner] * self.size + flat[inner + 1], return_inverse=True)
        wrong = inner[~self.compatible(key // self.size, key % self.size)[back]]
        failing = np.unique(np.searchsorted(stops, wrong, "right"))
        sizes = stops - starts
        if len(failing):
            exact = [self.merge(words[w]) for w in failing.tolist()]
            old, sizes[failing] = sizes.copy(), np.fromiter(map(len, exact), np.int64)
            new = np.concatenate([[0], np.cumsum(sizes)])
            out = np.empty(new[-1], np.int64)
            kept = np.ones(len(words), bool)
            kept[failing] = False
            out[np.repeat(kept, sizes)] = flat[np.repeat(kept, old)]
            out[np.repeat(~kept, sizes)] = np.fromiter(chain.from_iterable(exact), np.int64)
            flat, stops = out, new[1:]
        return self.outer[flat].tobytes(), [0, *(stops * 4).tolist()]

    def learn(self, chunks: list[str]) -> None:
        """Encodes chunks without white space into the cache."""
        found = self.words.findall
        words: dict[str, int] = {}
        number = words.setdefault
        plans: list = []
        joined = "\n".join(chunks)
        odd = is_odd if is_odd(joined) else lambda part: False
        lowered = unicodedata.normalize("NFC", joined).replace("Σ", "σ").lower().split("\n")  # sigma: letter by letter

        def split(part: str) -> list[int]:
            if odd(part):
                return [number(w, len(words)) for w, _ in self.cut(self.normalise(part))]
            return [number(w, len(words)) for w in found(unicodedata.normalize("NFC", part).replace("Σ", "σ").lower())]

        for chunk, low in zip(chunks, lowered):
            if odd(chunk):
                low = ""  # not as Python has it
            if low.isalpha():
                plans.append(number(low, len(words)))
            elif "<|" in chunk and self.splitter and self.splitter.search(chunk):
                plan, at = [], 0
                for m in chain(self.splitter.finditer(chunk), [None]):
                    plan += split(chunk[at : m.start() if m else None])
                    if m:
                        plan.append(m[0])
                        at = m.end()
                plans.append(plan)
            elif low and low[-1] in ".,;:!?" and low[:-1].isalpha():
                plans.append([number(low[:-1], len(words)), number(low[-1], len(words))])
            else:
                plans.append([number(w, len(words)) for w in found(low)] if low else split(chunk))
        raw = [w.encode() for w in words]
        packed, at = self.encode_words([w[:-1].decode("latin-1") + chr(256 + w[-1]) for w in raw]) if raw else (b"", [0])
        special = {t: i.to_bytes(4, "little") for t, i in self.special.items()}
        for chunk, plan in zip(chunks, plans):
            if isinstance(plan, int):
                self.cache[chunk] = packed[at[plan] : at[plan + 1]]
            else:
                self.cache[chunk] = b"".join([packed[at[x] : at[x + 1]] if isinstance(x, int) else special[x] for x in plan])

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Packed ids of each text; texts are split together up to AT_ONCE letters, so that few chunks are held at a time."""
        out, i = [], 0
        while i < len(texts):
            j, letters = i, 0
            while j < len(texts) and (j == i or letters + len(texts[j] or "") <= AT_ONCE):
                letters += len(texts[j] or "")
                j += 1
            out += self.encode_some(texts[i:j])
            i = j
        return out

    def encode_some(self, texts: list[str | None]) -> list[bytes]:
        split = [(UNSPACED.split(t) if UNSPACED_RARE.search(t) else t.split()) if t else [] for t in texts]
        wanted = set(chain.from_iterable(split))
        missing = list(wanted.difference(self.cache))
        if len(self.cache) + len(missing) > CACHED_CHUNKS:  # what these texts have is kept
            self.cache = {c: self.cache[c] for c in wanted.intersection(self.cache)}
        for i in range(0, len(missing), LEARNED):
            self.learn(missing[i : i + LEARNED])
        get = self.cache.__getitem__
        return [b"".join(map(get, chunks)) for chunks in split]

    def forget(self) -> None:
        self.cache = {}

    def decode(self, ids: bytes | None) -> bytes:
        """The tokens' texts with single spaces between them, as there is no decoder in the file; unknown ids are left out."""
        n, texts = len(self.texts), self.texts
        try:
            return b" ".join([texts[i] for i in memoryview(ids or b"").cast("I")])
        except (IndexError, TypeError):
            return b" ".join([texts[i] for i in memoryview(ids).cast("I") if i < n and texts[i] is not None])


@functools.lru_cache(2)
def _model(raw: bytes) -> WordBpe:
    return WordBpe(raw)


class Bpe:
    """Column functions for the vocabulary in a file; the file's bytes, of bounded size, go to the executors."""

    def __init__(self, spark: SparkSession, path: str):
        raw = open(path, "rb").read()
        if len(raw) > MAX_VOCABULARY_BYTES:
            raise ValueError(f"{path} has {len(raw)} bytes; at most {MAX_VOCABULARY_BYTES} are sent to the executors")
        small_batches(spark)
        sent = spark.sparkContext.broadcast(raw)

        @F.arrow_udf("binary")
        def encode(texts: pa.Array) -> pa.Array:
            model = _model(sent.value)
            claim("bpe", model.forget)
            return pa.array(model.encode(texts.to_pylist()), pa.binary())

        @F.arrow_udf("string")
        def decode(ids: pa.Array) -> pa.Array:
            model = _model(sent.value)
            return pa.array([model.decode(x) for x in ids.to_pylist()], pa.binary()).cast(pa.string())

        @F.arrow_udf("struct<ids: binary, text: string>")
        def both(texts: pa.Array) -> pa.Array:
            model = _model(sent.value)
            claim("bpe", model.forget)
            ids = model.encode(texts.to_pylist())
            return pa.StructArray.from_arrays([pa.array(ids, pa.binary()), pa.array([model.decode(x) for x in ids], pa.binary()).cast(pa.string())], ["ids", "text"])

        self._encode, self._decode, self._both = encode, decode, both

    def encode(self, text: Column) -> Column:
        """Packed ids of a text; none for a null."""
        return self._encode(text)

    def decode(self, ids: Column) -> Column:
        """The text of packed ids."""
        return self._decode(ids)

    def round_trip(self, text: Column) -> Column:
        """A struct of a text's packed ids and the text that they decode to, made by one worker instead of two."""
        return self._both(text)
