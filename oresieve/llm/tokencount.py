"""Token counts by a deterministic transducer compiled from a BPE vocabulary with marked word ends.

A state of the transducer is all that later tokens of a word can depend on: where the suffix automaton over the vocabulary
stands, and for each place that a later token may reach back to, the last token and the count there. A transition is
annotated with the tokens that it emits: the count after the symbol less the count before it, below zero where a longer
token replaces several. States and transitions are compiled as texts need them. Long texts are cut into chunks, also inside
words; each chunk is a map from the state before it to the state after it and the tokens emitted between, and the maps compose
by a parallel prefix scan.
"""

from __future__ import annotations

import json
import re
import unicodedata

import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from .bpe import MARKS, WHITE, Memo, Merges, loaded
from .shared import file_bytes, small_batches

#: Transitions that a worker holds; beyond, it compiles anew. Characters of a chunk of text.
MOST_TRANSITIONS, CHUNK_CHARS = 1_000_000, 1 << 15
#: Characters before a chunk from which the state at its start is foretold; a map is run anew for a state that was not.
LOOK_BACK = 24
#: Letters whose lower case is one letter and that nothing before them changes, and these with digits and white space.
#: Between four of the latter no contraction ends, and whether a word goes on is known from the two characters around the cut.
LETTERS = "a-zA-Z\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fff\uac00-\ud7a3"
PLAIN = LETTERS + "0-9 \\n\\t"
#: Fixed value: the public pattern that this vocabulary splits words by.
WORD_PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d|[\p{{L}}]+|[\p{{N}}]|[^{WHITE}\p{{L}}\p{{N}}]+"

#: The state before a word.
START = (0, (-1,), (0,))


class Transducer:
    """Reads a word's symbols one by one and emits how many tokens each adds."""

    def __init__(self, merges: Merges):
        self.merges = merges
        self.children: list[dict[int, int]] = [{}]
        self.depth, self.token = [0], [-1]
        for t in merges.usable:
            node = 0
            for c in map(ord, merges.text[t]):
                step = self.children[node]
                if c not in step:
                    step[c] = len(self.children)
                    self.children.append({})
                    self.depth.append(self.depth[node] + 1)
                    self.token.append(-1)
                node = step[c]
            self.token[node] = t
        self.suffix = [0] * len(self.children)
        queue = list(self.children[0].values())
        for node in queue:
            for c, child in self.children[node].items():
                self.suffix[child] = self._next(self.suffix[node], c)
                queue.append(child)
        self.reset()

    def reset(self) -> None:
        self.states: list[tuple] = [START]
        self.number = {START: 0}
        self.steps: dict[int, tuple[int, int]] = {}

    def _renewed(self, state: int) -> int:
        """Forgets all states but the one reached, so that even a word of many millions of symbols takes bounded memory."""
        key = self.states[state]
        self.reset()
        if key not in self.number:
            self.number[key] = len(self.states)
            self.states.append(key)
        return self.number[key]

    def _next(self, node: int, symbol: int) -> int:
        """Where the automaton goes: the longest suffix of what was read that begins some token."""
        while symbol not in self.children[node]:
            if node == 0:
                return 0
            node = self.suffix[node]
        return self.children[node][symbol]

    def _compile(self, state: int, symbol: int) -> tuple[int, int]:
        """The transition from a state: the next state, and the tokens emitted."""
        node, last, count = self.states[state]
        after = self._next(node, symbol)
        reach, end = self.depth[after], len(last)
        at = after
        while True:
            token = self.token[at]
            if token >= 0:
                start = end - self.merges.length[token]
                before = last[start]
                if before < 0 or self.merges.compatible(before, token):
                    break
            at = self.suffix[at]
        emitted = count[start] + 1
        window = (*last, token)[end - reach :]
        counts = tuple(c - emitted for c in (*count, emitted)[end - reach :])
        key = (after, window, counts)
        if key not in self.number:
            self.number[key] = len(self.states)
            self.states.append(key)
        return self.number[key], emitted

    def run(self, before: tuple, symbols) -> tuple[tuple, int]:
        """The state that symbols lead to from a state, and the tokens emitted on the way."""
        state, total = self.number.get(before, -1), 0
        if state < 0:
            state = self.number[before] = len(self.states)
            self.states.append(before)
        steps = self.steps
        for symbol in symbols:
            step = steps.get(state << 9 | symbol)
            if step is None:
                if len(steps) >= MOST_TRANSITIONS:
                    state, steps = self._renewed(state), self.steps
                step = steps[state << 9 | symbol] = self._compile(state, symbol)
            state = step[0]
            total += step[1]
        return self.states[state], total

    def symbols(self, word: bytes):
        """A whole word's symbols: its last byte is the one that ends a word, where the vocabulary has such."""
        return [*word[:-1], word[-1] + 256] if self.merges.suffix and word else word

    def count(self, word: bytes) -> int:
        """Tokens of a word."""
        return self.run(START, self.symbols(word))[1]


class ChunkMap:
    """What a chunk does to the transducer: called with the state before it, it gives the state after it and the tokens emitted.

    head: the symbols that go on with an open word, to its end or to the chunk's (inside); then, from the start state, come `count` tokens
    and the symbols of a word left open. Results are remembered for the states met. Called with more maps, the chunk is all of them.
    """

    __slots__ = ("transducer", "parts", "head", "inside", "count", "tail", "known")

    def __init__(self, transducer: Transducer, head=b"", inside: bool = False, count: int = 0, tail=b"", parts: tuple = ()):
        self.transducer, self.parts, self.head, self.inside = transducer, parts, head, inside
        self.known: dict[tuple, tuple[tuple, int]] = {}
        self.tail, emitted = transducer.run(START, tail) if tail else (START, 0)
        self.count = count + emitted

    def __call__(self, before: tuple) -> tuple[tuple, int]:
        found = self.known.get(before)
        if found is None:
            if self.parts:
                after, found = before, 0
                for part in self.parts:
                    after, emitted = part(after)
                    found += emitted
                found = after, found
            else:
                after, emitted = self.transducer.run(before, self.head) if len(self.head) else (before, 0)
                found = (after, emitted) if self.inside else (self.tail, emitted + self.count)
            self.known[before] = found
        return found


def compose(a: ChunkMap, b: ChunkMap) -> ChunkMap:
    """The map of a and then b, for all states that a has met; associative."""
    both = ChunkMap(a.transducer, parts=(a, b))
    for state in a.known:
        both(state)
    return both


def scan(maps: list[ChunkMap]) -> list[ChunkMap]:
    """All prefixes' maps, by a scan of logarithmic depth: pairs compose first, then the halves' prefixes fill the gaps."""
    if len(maps) < 2:
        return list(maps)
    halves = scan([compose(a, b) for a, b in zip(maps[::2], maps[1::2], strict=False)])
    return [halves[k // 2] if k % 2 else compose(halves[k // 2 - 1], m) if k else m for k, m in enumerate(maps)]


def composed(maps: list[ChunkMap]) -> ChunkMap:
    """The map of all, by the scan's upward half: neighbours compose until one is left."""
    while len(maps) > 1:
        odd = maps[len(maps) // 2 * 2 :]
        maps = [compose(a, b) for a, b in zip(maps[::2], maps[1::2], strict=False)] + odd
    return maps[0]


class WordCounter:
    """Counts the tokens of texts for a vocabulary that lower-cases, drops white space and marks word ends."""

    def __init__(self, spec_bytes: bytes):
        spec = json.loads(spec_bytes)
        kinds = [n["type"] for n in (spec.get("normalizer") or {}).get("normalizers", [])]
        if kinds != ["NFC", "Replace", "Lowercase"] or not spec["model"].get("end_of_word_suffix"):
            raise ValueError("only lower-casing vocabularies with word ends are read")
        self.transducer = Transducer(Merges(spec))
        added = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, added)))
        self.longest = max(map(len, added), default=0)
        self.pattern = regex.compile(WORD_PATTERN)
        self.white = re.compile(f"[{WHITE}]+")
        self.plain, self.letter = re.compile(f"[{PLAIN}]{{4}}"), re.compile(f"[{LETTERS}]")
        #: Python's split() also cuts at these four; the vocabulary does not.
        self.separators = re.compile("[\x1c-\x1f]")
        self.words = Memo(lambda w: self.transducer.count(w.encode()))
        self.run = Memo(self._run)

    def _run(self, run: str) -> int:
        """Tokens of a run without white space; a special token in it is one."""
        if run.isascii():
            if run.isalpha():
                return self.words[run.lower()]
            if run[-1] in MARKS and run[:-1].isalpha():
                return self.run[run[:-1]] + self.words[run[-1]]
        words = self.words
        total = -1
        for part in self._split(run):
            total += 1 + sum([words[w] for w in part])
        return total

    def _split(self, run: str) -> list[list[str]]:
        """The words of a run, in a list for each stretch between special tokens."""
        return [self.pattern.findall(unicodedata.normalize("NFC", part).replace("Σ", "σ").lower()) for part in self.special.split(run)]

    def _runs(self, text: str) -> list[str]:
        if self.separators.search(text):
            return [r for r in self.white.split(text) if r]
        return text.split()

    def cuts(self, text: str, chunk_chars: int) -> list[int]:
        """Where chunks begin: after chunk_chars characters or the next place where four plain ones meet, outside of special tokens."""
        out, at = [0], chunk_chars
        while at < len(text) and (m := self.plain.search(text, max(at - 3, out[-1]))):
            at = m.start() + 3
            first = max(0, at - self.longest)
            if self.longest and any(first + x.start() < at < first + x.end() for x in self.special.finditer(text[first : at + self.longest])):
                at += 1
                continue
            out.append(at)
            at += chunk_chars
        return out

    def maps(self, text: str, chunk_chars: int = CHUNK_CHARS) -> list[ChunkMap]:
        """A map for each chunk, already run from the state that the characters before it foretell."""
        starts = self.cuts(text, chunk_chars)
        ends = [*starts[1:], len(text)]
        goes_on = [bool(self.letter.match(text, c - 1) and self.letter.match(text, c)) for c in starts[1:]]
        out, foretold = [], START
        for a, b, before, after in zip(starts, ends, [False, *goes_on], [*goes_on, False], strict=True):
            chunk = self._map(text[a:b], before, after)
            chunk(foretold)
            out.append(chunk)
            foretold = START
            if after:
                word = self.pattern.findall(unicodedata.normalize("NFC", text[max(a, b - LOOK_BACK) : b]).replace("Σ", "σ").lower())[-1]
                foretold = self.transducer.run(START, word.encode())[0]
        return out

    def _map(self, chunk: str, before: bool, after: bool) -> ChunkMap:
        runs, symbols = self._runs(chunk), self.transducer.symbols
        head = tail = b""
        count = 0
        if before or after:
            first, last = self._split(runs[0]), self._split(runs[-1])
            if before and after and len(runs) == len(first) == len(first[0]) == 1:
                return ChunkMap(self.transducer, first[0][0].encode(), True)
            if len(runs) == 1:
                last = first
            if before:
                head = symbols(first[0].pop(0).encode())
            if after:
                tail = last[-1].pop().encode()
            for parts in [first] if first is last else [first, last]:
                count += len(parts) - 1 + sum(self.words[w] for part in parts for w in part)
            runs = runs[1:-1]
        return ChunkMap(self.transducer, head, False, count + sum(map(self.run.__getitem__, runs)), tail)

    def prefix_counts(self, text: str, chunk_chars: int = CHUNK_CHARS) -> list[int]:
        """The tokens of the text up to the end of each chunk; of a word that goes on there, those of its part so far."""
        return [m(START)[1] for m in scan(self.maps(text, chunk_chars))]

    def count(self, text: str, chunk_chars: int = CHUNK_CHARS) -> int:
        """The tokens of a text. A text of one chunk has no state before it but the start."""
        if len(text) <= chunk_chars:
            return sum(map(self.run.__getitem__, self._runs(text)))
        return composed(self.maps(text, chunk_chars))(START)[1]


def token_counts(docs: DataFrame, vocabulary: str, text: str = "text", n_bytes: str = "n_bytes", n_tokens: str = "n_tokens") -> DataFrame:
    """Adds the UTF-8 bytes and the tokens of every whole text, as the vocabulary's library counts them without specials around.

    A null text counts as empty. Rows stay as they are and other columns pass; a column of the input that has the name of a
    new one is replaced. No shuffle; a worker holds one transducer, bounded memos and one small batch.
    """
    spark = docs.sparkSession
    small_batches(spark)
    spec = spark.sparkContext.broadcast(file_bytes(vocabulary))
    new = [n_bytes, n_tokens]
    kept = [c for c in docs.columns if c.lower() not in {n.lower() for n in new}]
    carried = kept if text in kept else [*kept, text]

    def run(batches):
        counter = loaded(WordCounter, spec.value)
        for batch in batches:
            texts = batch.column(carried.index(text)).fill_null("")
            counts = pa.array([counter.count(t) for t in texts.to_pylist()], pa.int64())
            columns = [batch.column(k) for k in range(len(kept))]
            yield pa.RecordBatch.from_arrays([*columns, pc.cast(pc.binary_length(texts), pa.int64()), counts], names=[*kept, *new])

    schema = docs.select(*kept).schema.add(n_bytes, "long", False).add(n_tokens, "long", False)
    return docs.select(*carried).mapInArrow(run, schema)
