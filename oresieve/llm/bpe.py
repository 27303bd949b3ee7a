"""Byte-pair encoding and decoding by dynamic programming over prefixes, after public work on linear-time BPE.

For every prefix of a word exactly one token can be the last of its encoding. An automaton with suffix links gives the
tokens that end at a place; the one that is compatible with the last token of the prefix before it is stored, and the
stored tokens are followed back from the end. Two tokens are compatible if merging their joined text leaves the border open.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .shared import file_bytes, small_batches

#: Unicode's White_Space, which the pre-tokenizers mean by \s; Python's own \s has more.
WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: Fixed value: the public pattern that byte-level vocabularies split words by.
BYTE_PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{WHITE}\p{{L}}\p{{N}}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+"
#: Marks that are a word of their own after letters.
MARKS = frozenset(".,;:!?")
#: Entries of a generation of each bounded memo of a worker, and characters of the longest text that one holds.
MEMO_ENTRIES, MEMO_CHARS = 250_000, 64
#: Text bytes turned into one Arrow batch of results.
BATCH_BYTES = 8_000_000
#: Characters of a text that are split into words at once, and ids that are decoded at once.
PIECE = 1 << 20


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: printable Latin-1 as itself, others from U+0100 on."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = (chr(c) for c in range(0x100, 0x200))
    return [chr(b) if b in own else next(rest) for b in range(256)]


class Memo(dict):
    """A function's results for keys seen of late, in two generations: a full one becomes the old one, and what is used again moves up.

    Long keys are not kept.
    """

    def __init__(self, function, entries: int = MEMO_ENTRIES):
        super().__init__()
        self.function, self.entries, self.old = function, entries, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.function(key)
            if len(key) > MEMO_CHARS:
                return value
        if len(self) >= self.entries:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


class Merges:
    """A BPE vocabulary: tokens as strings of symbols, how each came about, and which pairs of tokens may stand side by side.

    A symbol is chr(byte), or chr(256 + byte) for a word's last byte where the vocabulary marks word ends.
    """

    def __init__(self, spec: dict):
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.byte_of = {c: b for b, c in enumerate(byte_letters())}
        self.size = max(self.vocab.values()) + 1
        self.text = [""] * self.size
        self.left, self.right, self.rank = [-1] * self.size, [-1] * self.size, [-1] * self.size
        self.pair_rank: dict[int, int] = {}
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        made = {a + b for a, b in pairs}
        usable = [False] * self.size
        for token, i in self.vocab.items():
            if token not in made and (s := self._symbols(token)) and len(s) == 1:
                self.text[i], usable[i] = s, True
        for r, (a, b) in enumerate(pairs):
            x, y, i = self.vocab[a], self.vocab[b], self.vocab[a + b]
            if max(self.rank[x], self.rank[y]) >= r or not self.text[x] or not self.text[y]:
                raise ValueError("merges must build on earlier merges")
            self.pair_rank.setdefault(x * self.size + y, r)
            if self.rank[i] < 0:
                self.text[i], self.left[i], self.right[i], self.rank[i] = self.text[x] + self.text[y], x, y, r
                usable[i] = usable[x] and usable[y] and self._apart(x, y, True)
        self.usable = [i for i in range(self.size) if usable[i]]
        self.length = [len(s) for s in self.text]
        self._known: dict[int, bool] = {}

    def _symbols(self, token: str) -> str:
        ends = self.suffix and token.endswith(self.suffix) and token != self.suffix
        body = token[: len(token) - len(self.suffix)] if ends else token
        try:
            s = [self.byte_of[c] for c in body]
        except KeyError:
            return ""
        if ends:
            s[-1] += 256
        return "".join(map(chr, s))

    def _apart(self, a: int, b: int, parts_of_one: bool = False) -> bool:
        """Whether no merge crosses the border of a and b while they are built. parts_of_one: their own merge does not count.

        Undoes merges from the latest back. The two tokens that touch the border stand side by side until one of them
        goes into its next merge, so a merge of the two wins if it ranks before that; of equal ranks the left place wins.
        """
        a_until = b_until = len(self.rank) + 1
        if parts_of_one:
            a_until = b_until = self.pair_rank[a * self.size + b]
        first = parts_of_one
        while True:
            m = self.pair_rank.get(a * self.size + b)
            if m is not None and not first and m < a_until and m <= b_until:
                return False
            first = False
            if self.rank[a] < 0 and self.rank[b] < 0:
                return True
            if self.rank[a] > self.rank[b]:
                a_until, a = self.rank[a], self.right[a]
            else:
                b_until, b = self.rank[b], self.left[b]

    def compatible(self, a: int, b: int) -> bool:
        """Whether b may follow a in an encoding; remembered for a bounded number of pairs."""
        key = a * self.size + b
        known = self._known.get(key)
        if known is None:
            if len(self._known) >= 4 * MEMO_ENTRIES:
                self._known.clear()
            known = self._known[key] = self._apart(a, b)
        return known

    def word(self, symbols: str) -> list[int]:
        """The ids of a string of symbols, as merging by rank gives them."""
        n, length, size, known = len(symbols), self.length, self.size, self._known.get
        last = [-1] * n
        for end, token in self.matches.iter(symbols):
            if last[end] < 0:
                start = end - length[token]
                if start < 0:
                    last[end] = token
                else:
                    before = last[start]
                    fits = known(before * size + token)
                    if fits or (fits is None and self.compatible(before, token)):
                        last[end] = token
        ids, at = [], n - 1
        while at >= 0:
            ids.append(last[at])
            at -= length[last[at]]
        ids.reverse()
        return ids

    @property
    def matches(self):
        """The automaton with suffix links over all tokens that an encoding can hold; of the tokens that end at a place, one fits."""
        if not hasattr(self, "_matches"):
            self._matches = ahocorasick.Automaton()
            for i in self.usable:
                self._matches.add_word(self.text[i], i)
            self._matches.make_automaton()
        return self._matches


class ByteBPE:
    """Encodes and decodes with a byte-level tokenizer file; added tokens found in a text become their ids, as the library does by default."""

    def __init__(self, spec_bytes: bytes):
        spec = json.loads(spec_bytes)
        pre = spec.get("pre_tokenizer") or {}
        if pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or spec.get("normalizer"):
            raise ValueError("only plain byte-level tokenizers are read")
        self.merges = Merges(spec)
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.added = {c: array("I", [i]).tobytes() for c, i in added.items()}
        self.special = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
        size = max(self.merges.size, *(i + 1 for i in added.values())) if added else self.merges.size
        self.bytes_of = [t.encode("latin-1") for t in self.merges.text] + [b""] * (size - self.merges.size)
        for content, i in added.items():
            self.bytes_of[i] = content.encode()
        self.pattern = regex.compile(BYTE_PATTERN)
        #: A space before anything but white space begins a word whatever stands before it.
        self.cut = re.compile(f" (?=[^{WHITE}])")
        self.words = Memo(self._word)
        self.plain, self.spaced = Memo(lambda c: self._chunk("", c)), Memo(lambda c: self._chunk(" ", c))

    def _word(self, word: str) -> bytes:
        return array("I", self.merges.word(word.encode().decode("latin-1"))).tobytes()

    def _chunk(self, space: str, chunk: str) -> bytes:
        """A chunk's ids. Letters are one word, and one mark after letters another: these need no pattern."""
        if chunk.isalpha():
            return self._word(space + chunk)
        if chunk[-1:] in MARKS and chunk[:-1].isalpha():
            return (self.spaced if space else self.plain)[chunk[:-1]] + self.words[chunk[-1]]
        words = self.words
        return b"".join([words[w] for w in self.pattern.findall(space + chunk)])

    def _part(self, text: str, piece: int = PIECE) -> bytes:
        """The ids of a text between added tokens. A long one is cut where a word begins with its space, as no word reaches over it."""
        out, at = [], 0
        while at < len(text):
            cut = self.cut.search(text, at + piece) if len(text) - at > piece else None
            end = cut.start() if cut else len(text)
            first, *rest = self.cut.split(text[at:end])
            out.append(self.plain[first] + b"".join(map(self.spaced.__getitem__, rest)))
            at = end
        return out[0] if len(out) == 1 else b"".join(out)

    def encode(self, text: str) -> bytes:
        """The ids as unsigned 32-bit numbers, little-endian."""
        if self.special is None or not any(c in text for c in self.added):
            return self._part(text)
        return b"".join(self.added[p] if k % 2 else self._part(p) for k, p in enumerate(self.special.split(text)))

    def decode(self, ids: bytes) -> str:
        """The text of the ids, added tokens included; bytes that are no UTF-8 become U+FFFD."""
        numbers = memoryview(ids).cast("I")
        pieces = [b"".join(map(self.bytes_of.__getitem__, numbers[k : k + PIECE])) for k in range(0, len(numbers), PIECE)]
        return b"".join(pieces).decode("utf-8", "replace")


_loaded: dict[tuple, object] = {}


def loaded(kind, spec: bytes):
    """One vocabulary of each kind in a Python worker, read once."""
    key = (kind.__name__, hashlib.sha256(spec).hexdigest())
    if key not in _loaded:
        _loaded[key] = kind(spec)
    return _loaded[key]


def encode_decode(docs: DataFrame, vocabulary: str, text: str = "text", ids: str = "ids", decoded: str | None = "decoded") -> DataFrame:
    """Adds the ids of every whole text, as binary (unsigned 32-bit, little-endian), and the text decoded from these ids.

    vocabulary: a byte-level tokenizer file, read on the driver. decoded None: encoding only. A null text counts as empty
    and has no ids. Rows stay as they are, in number and order, and other columns pass; a column of the input that has the
    name of a new one is replaced. No shuffle; a worker holds one vocabulary, bounded memos and one small batch.
    """
    spark = docs.sparkSession
    small_batches(spark)
    spec = spark.sparkContext.broadcast(file_bytes(vocabulary))
    new = [ids] + ([decoded] if decoded else [])
    kept = [c for c in docs.columns if c.lower() not in {n.lower() for n in new}]
    carried = kept if text in kept else [*kept, text]

    def run(batches):
        bpe = loaded(ByteBPE, spec.value)
        for batch in batches:
            texts = batch.column(carried.index(text)).to_pylist()
            start, held, done = 0, 0, []
            for i, t in enumerate(texts):
                done.append(bpe.encode(t or ""))
                held += len(done[-1])
                if held > BATCH_BYTES or i + 1 == len(texts):
                    columns = [batch.column(k).slice(start, len(done)) for k in range(len(kept))]
                    columns.append(pa.array(done, pa.binary()))
                    if decoded:
                        columns.append(pa.array([bpe.decode(x) for x in done], pa.string()))
                    yield pa.RecordBatch.from_arrays(columns, names=[*kept, *new])
                    start, held, done = i + 1, 0, []

    schema = docs.select(*kept).schema.add(ids, "binary", False)
    if decoded:
        schema = schema.add(decoded, "string", False)
    return docs.select(*carried).mapInArrow(run, schema)
