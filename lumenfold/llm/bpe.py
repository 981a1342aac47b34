"""BPE encoding and decoding by speculation and verification.

For each distinct word of a group of texts, greedy longest match proposes tokens. A proposal is the encoding
exactly if no merge would cross the border of any two neighbouring tokens. That is tested for all pairs of all
words at once in numpy, by undoing both tokens' merges from the latest on and looking up the pair at the
border each time. Only words with a failing pair go through the merges one by one. Words and their ids are
kept in a bounded cache of the Python worker; rows never meet, so there is no shuffle.

The vocabulary is a tokenizer file of byte-level BPE with word ends; its text rules (NFC, lower case, the
pattern that finds words, special tokens) follow that file. Texts with characters beyond Latin letters have
their characters normalised and split by the file's own rules in the tokenizers library, whose Unicode tables
may differ from Python's.

Defined cases: null and empty texts have no tokens and decode to the empty text. A special token's string in a
text is that token. Repeated rows and equal ids don't matter. Further columns are carried along; one with the
name of a result is replaced. Very long words take n log n time.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import json
import unicodedata
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from lumenfold.llm.common import add_columns

#: Fixed values of the tokenizer file's format: the word pattern, the word end and its special tokens.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
WORD_END = "</w>"

CACHED_WORDS = 250_000
GROUP_CHARS = 1 << 20
_NEVER = np.int64(1) << 40
_END = "￿"


def _byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: printable bytes stand for themselves."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class Model:
    """A vocabulary, its merges, and the tables that the border test needs."""

    def __init__(self, file: bytes) -> None:
        spec = json.loads(file)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in merges]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.tokens = [""] * size
        for token, i in [*vocab.items(), *self.special.items()]:
            self.tokens[i] = token
        self.letters = {b: letter for b, letter in enumerate(_byte_letters())}
        self.rank = np.full(size, -1, np.int64)
        self.left, self.right = np.zeros(size, np.int64), np.zeros(size, np.int64)
        self.merge: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, (a, b) in enumerate(merges):
            made = vocab[a + b]
            self.merge[vocab[a], vocab[b]] = rank, made
            self.rank[made], self.left[made], self.right[made] = rank, vocab[a], vocab[b]
        codes = np.array([a << 32 | b for a, b in self.merge], np.int64)
        order = np.argsort(codes)
        self.codes, self.ranks = codes[order], np.arange(len(codes), dtype=np.int64)[order]
        valid = self._reachable()
        self.match = {t.replace(WORD_END, _END) if t.endswith(WORD_END) else t: i for t, i in vocab.items() if valid[i]}
        self.base = {t.replace(WORD_END, _END): i for t, i in vocab.items() if self.rank[i] < 0}
        self.reach: dict[str, int] = {}  # the longest token that begins with these two letters
        for t in self.match:
            self.reach[t[:2]] = max(len(t), self.reach.get(t[:2], 1))
        self.rules = file

    def _reachable(self) -> np.ndarray:
        """Tokens whose own string encodes as that token."""
        valid = np.ones(len(self.tokens), bool)
        made = np.flatnonzero(self.rank >= 0)
        valid[made] = self.compatible(self.left[made], self.right[made], self.rank[made])
        for t in made[np.argsort(self.rank[made])]:
            valid[t] &= valid[self.left[t]] and valid[self.right[t]]
        return valid

    def compatible(self, x: np.ndarray, y: np.ndarray, until: np.ndarray | None = None) -> np.ndarray:
        """Whether no merge crosses the border of tokens x and y (before merge number ``until``)."""
        out = np.ones(len(x), bool)
        at = np.arange(len(x))
        until_x = until_y = np.full(len(x), _NEVER) if until is None else until
        while len(at):
            code = x << 32 | y
            spot = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
            rank = np.where(self.codes[spot] == code, self.ranks[spot], _NEVER)
            # Of equal merges the left one goes first: one ending in x before this, one beginning with y after it.
            crossed = (rank < until_x) & (rank <= until_y) & (rank < _NEVER)
            out[at[crossed]] = False
            rx, ry = self.rank[x], self.rank[y]
            undo_x = rx > ry
            until_x, until_y = np.where(undo_x, rx, until_x), np.where(undo_x, until_y, ry)
            go = ~crossed & ((rx >= 0) | (ry >= 0))
            x, y = np.where(undo_x, self.right[x], x), np.where(undo_x, y, self.left[y])
            at, x, y, until_x, until_y = at[go], x[go], y[go], until_x[go], until_y[go]
        return out

    def greedy(self, word: str) -> list[int]:
        """Longest match from the left; the last token holds the word's end."""
        out, i, n, get, reach = [], 0, len(word), self.match.get, self.reach.get
        while i < n:
            for j in range(min(n, i + reach(word[i : i + 2], 1)), i, -1):
                if j != n - 1 and (token := get(word[i:j])) is not None:
                    break
            out.append(token)
            i = j
        return out

    def merged(self, word: str) -> list[int]:
        """The merges themselves, from the first rank on and left to right, on a linked list with a heap."""
        ids = [self.base[c] for c in word[:-2]] + [self.base[word[-2:]]]
        n = len(ids)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        heap = [(*self.merge[p], i, p) for i in range(n - 1) if (p := (ids[i], ids[i + 1])) in self.merge]
        heapq.heapify(heap)
        while heap:
            _, made, i, pair = heapq.heappop(heap)
            j = after[i]
            if j < 0 or (ids[i], ids[j]) != pair:
                continue
            ids[i], ids[j], after[i] = made, -1, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for k in (before[i], i):
                if k >= 0 and after[k] >= 0 and (p := (ids[k], ids[after[k]])) in self.merge:
                    heapq.heappush(heap, (*self.merge[p], k, p))
        return [t for t in ids if t >= 0]

    def encode_words(self, words: list[str]) -> list[list[int]]:
        """The ids of each word (letters for bytes, without its end)."""
        ended = [w + _END for w in words]
        proposed = [self.greedy(w) for w in ended]
        sizes = np.fromiter(map(len, proposed), np.int64, len(proposed))
        flat = np.fromiter((t for p in proposed for t in p), np.int64, int(sizes.sum()))
        owner = np.repeat(np.arange(len(words)), sizes)
        border = np.flatnonzero(owner[1:] == owner[:-1])
        pairs, where = np.unique(flat[border] << 32 | flat[border + 1], return_inverse=True)
        fits = self.compatible(pairs >> 32, pairs & 0xFFFFFFFF)[where]
        for k in np.unique(owner[border[~fits]]):
            proposed[k] = self.merged(ended[k])
        return proposed


class Encoder:
    """Texts to ids, with the cache of words."""

    def __init__(self, model: Model) -> None:
        self.model = model
        self.cache: dict[str, bytes] = {}
        self.find = regex.compile(PATTERN).findall
        self.beyond_latin = regex.compile("[^\\x00-ɏ]").search
        self.parts = regex.compile("(" + "|".join(map(regex.escape, model.special)) + ")").split
        self.as_letters = {b: letter for b, letter in model.letters.items()}
        self.library = None

    def words(self, text: str) -> list[str]:
        """Words in the order of the text. Those of the library's rules are marked: their letters stand for bytes."""
        if self.beyond_latin(text):
            if self.library is None:
                from tokenizers import Tokenizer

                self.library = Tokenizer.from_str(self.model.rules.decode())
            plain = self.library.normalizer.normalize_str(text)
            return [_END + w for w, _ in self.library.pre_tokenizer.pre_tokenize_str(plain)]
        return self.find((text if text.isascii() else unicodedata.normalize("NFC", text)).lower())

    def learn(self, words: Iterable[str]) -> None:
        new = list(words)
        letters = [w[1:] if w[0] == _END else w.encode().decode("latin-1").translate(self.as_letters) for w in new]
        for word, ids in zip(new, self.model.encode_words(letters)):
            self.cache[word] = np.array(ids, np.int32).tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian 32-bit words."""
        found = []
        for text in texts:
            parts = self.parts(text) if "<|" in text else [text]
            found.append([(p, None) if p in self.model.special else (None, self.words(p)) for p in parts])
        new = {w for parts in found for _, words in parts if words for w in words} - self.cache.keys()
        if len(self.cache) + len(new) > CACHED_WORDS:
            self.cache.clear()
            new = {w for parts in found for _, words in parts if words for w in words}
        if new:
            self.learn(new)
        get = self.cache.__getitem__
        special = {t: np.array([i], np.int32).tobytes() for t, i in self.model.special.items()}
        return [b"".join(special[t] if t else b"".join(map(get, words)) for t, words in parts) for parts in found]


@functools.lru_cache(1)
def _encoder(digest: str, _load) -> Encoder:
    return Encoder(Model(_load.value))


class _Once:
    """A broadcast file, told apart by its digest so that a worker builds its tables once."""

    def __init__(self, shipped) -> None:
        self.shipped = shipped

    @property
    def value(self) -> bytes:
        return self.shipped.value

    def __eq__(self, other: object) -> bool:
        return isinstance(other, _Once)

    def __hash__(self) -> int:
        return 0


IDS = T.StructType([T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())])


def encode(documents: DataFrame, vocabulary: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``documents`` with the token ids of ``text`` and the text they decode to. ``vocabulary``: a file's path."""
    with open(vocabulary, "rb") as file:
        content = file.read()
    shipped, digest = documents.sparkSession.sparkContext.broadcast(content), hashlib.sha256(content).hexdigest()

    def compute(texts: pa.Array) -> list:
        encoder = _encoder(digest, _Once(shipped))
        rows, out, at = texts.to_pylist(), [], 0
        while at < len(rows):
            group, size = [], 0
            while at < len(rows) and (not group or size < GROUP_CHARS):
                group.append(rows[at] or "")
                size += len(group[-1])
                at += 1
            out += encoder.encode(group)
        offsets = np.concatenate(([0], np.cumsum([len(x) // 4 for x in out]))).astype(np.int32)
        ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(out), np.int32)))
        return [ids, _decode(ids, pa.array(encoder.model.tokens))]

    return add_columns(documents, [text], IDS, compute, keep)


def _decode(ids: pa.ListArray, tokens: pa.Array) -> pa.Array:
    spelled = pa.ListArray.from_arrays(ids.offsets, tokens.take(ids.values))
    return pc.binary_join(spelled, " ").fill_null("")


def decode(frame: DataFrame, vocabulary: str, ids: str = "ids") -> DataFrame:
    """``frame`` with ``decoded``: the tokens of ``ids``, special ones too, joined by spaces; null ids are none."""
    with open(vocabulary, "rb") as file:
        shipped = frame.sparkSession.sparkContext.broadcast(Model(file.read()).tokens)

    def compute(column: pa.Array) -> list:
        return [_decode(column.fill_null(pa.scalar([], column.type)), pa.array(shipped.value))]

    return add_columns(frame, [ids], T.StructType([IDS["decoded"]]), compute)
