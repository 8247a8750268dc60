"""BPE encoding by dynamic programming over prefixes.

For every prefix of a word exactly one vocabulary token can be the last token of its encoding. Reading a word from left
to right, a suffix automaton of the vocabulary names the tokens that end at each place; a token may stand there if it
forms a compatible pair with the last token of the prefix before it, that is, if no merge across their border would
come first. Back-pointers from the end then give the exact ids. Words repeat, so a bounded table keeps what was found.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from functools import lru_cache

from pyspark.sql import DataFrame

from marquee.llm.common import map_texts, text_rows

#: Words whose encodings a task keeps at a time.
TABLE = 800_000
#: Pairs of tokens whose compatibility a task keeps at a time.
PAIRS = 1_000_000
#: The space-like characters, as the tokenizer's expressions know them.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
END = 256


@lru_cache(1)
def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(other)) for b in range(256)]


class SuffixAutomaton:
    """All substrings of a set of symbol sequences; follows the longest suffix of what was read that is one of them."""

    def __init__(self, symbols: int) -> None:
        self.symbols = symbols
        self.next: dict[int, int] = {}
        self.link, self.length = [-1], [0]
        self.token = [-1]

    def _new(self, length: int) -> int:
        self.link.append(-1)
        self.length.append(length)
        self.token.append(-1)
        return len(self.link) - 1

    def _clone(self, of: int, length: int, came: int, symbol: int) -> int:
        k, copy = self.symbols, self._new(length)
        for s in self.out[of]:
            self.next[copy * k + s] = self.next[of * k + s]
        self.out.append(list(self.out[of]))
        self.link[copy], self.link[of] = self.link[of], copy
        while came >= 0 and self.next.get(came * k + symbol) == of:
            self.next[came * k + symbol] = copy
            came = self.link[came]
        return copy

    def extend(self, last: int, symbol: int) -> int:
        """State of the sequence that ends in `last`, one symbol longer (sequences of a set share their states)."""
        k = self.symbols
        there = self.next.get(last * k + symbol)
        if there is not None:
            return there if self.length[there] == self.length[last] + 1 else self._clone(there, self.length[last] + 1, last, symbol)
        new = self._new(self.length[last] + 1)
        self.out.append([])
        at = last
        while at >= 0 and at * k + symbol not in self.next:
            self.next[at * k + symbol] = new
            self.out[at].append(symbol)
            at = self.link[at]
        if at < 0:
            self.link[new] = 0
        else:
            there = self.next[at * k + symbol]
            self.link[new] = there if self.length[there] == self.length[at] + 1 else self._clone(there, self.length[at] + 1, at, symbol)
        return new

    def build(self, sequences: list[tuple[int, ...]]) -> None:
        self.out: list[list[int]] = [[]]
        ends = []
        for n, sequence in sorted(enumerate(sequences), key=lambda x: x[1]):
            at = 0
            for symbol in sequence:
                at = self.extend(at, symbol)
            ends.append((n, sequence))
        for n, sequence in ends:  # a clone may have taken over a state meanwhile, so places are looked up at the end
            at = 0
            for symbol in sequence:
                at = self.next[at * self.symbols + symbol]
            self.token[at] = n
        del self.out
        self.listed: list[list[tuple[int, int]] | None] = [None] * len(self.link)

    def tokens(self, at: int) -> list[tuple[int, int]]:
        """(number, length) of the tokens that are suffixes of the state's longest string, longest first."""
        found = self.listed[at]
        if found is None:
            found, up = [], at
            while up > 0:
                if self.token[up] >= 0:
                    found.append((self.token[up], self.length[up]))
                up = self.link[up]
            self.listed[at] = found
        return found


class Vocabulary:
    """A byte-level BPE vocabulary file of the tokenizers library."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names = {i: t for t, i in model["vocab"].items()} | {i: t for t, i in self.special.items()}
        byte_of = {c: b for b, c in enumerate(byte_alphabet())}

        def symbols(token: str) -> tuple[int, ...]:
            end = bool(self.suffix) and token.endswith(self.suffix) and len(token) > len(self.suffix)
            raw = [byte_of[c] for c in (token[: -len(self.suffix)] if end else token)]
            return (*raw[:-1], raw[-1] + END) if end else tuple(raw)

        vocab = model["vocab"]
        self.rank: dict[int, int] = {}
        self.halves: dict[int, tuple[int, int]] = {}
        self.pair: dict[tuple[int, int], int] = {}
        for rank, (a, b) in enumerate(model["merges"]):
            whole = vocab[a + b]
            self.pair[vocab[a], vocab[b]] = rank
            if whole not in self.rank:
                self.rank[whole], self.halves[whole] = rank, (vocab[a], vocab[b])
        self.base = {symbols(t)[0]: i for t, i in vocab.items() if i not in self.rank and len(symbols(t)) == 1}
        reachable = [(i, symbols(t)) for t, i in vocab.items() if i in self.rank and self.compatible(*self.halves[i], below=self.rank[i]) or i not in self.rank and len(symbols(t)) == 1]
        self.automaton = SuffixAutomaton(2 * END)
        self.automaton.build([s for _, s in reachable])
        self.ids = [i for i, _ in reachable]
        self.known: dict[int, bool] = {}

    def compatible(self, left: int, right: int, below: int = 1 << 60) -> bool:
        """Whether `left` and `right` can stand side by side at the end: no merge across their border comes before the
        merges that formed the pieces beside it. Undoes those merges from the last to the first."""
        while True:
            if self.pair.get((left, right), below) < below:
                return False
            a, b = self.rank.get(left, -1), self.rank.get(right, -1)
            if a < 0 and b < 0:
                return True
            if a > b:  # the left piece was formed last: before that, its right half stood at the border
                below, left = a, self.halves[left][1]
            else:  # the right piece was; at equal ranks a merge further left goes first
                below, right = b + 1, self.halves[right][0]

    def fits(self, left: int, right: int) -> bool:
        """compatible(), remembered in a bounded table."""
        key = left << 20 | right
        known = self.known.get(key)
        if known is None:
            if len(self.known) >= PAIRS:
                self.known.clear()
            known = self.known[key] = self.compatible(left, right)
        return known

    def encode_word(self, word: str) -> list[int]:
        """Ids of one word of the splitting expression."""
        raw = word.encode("utf-8", "replace")
        symbols = [*raw[:-1], raw[-1] + END] if self.suffix else list(raw)
        automaton, ids_of, known, fits = self.automaton, self.ids, self.known, self.fits
        following, link, longest, listed, width = automaton.next, automaton.link, automaton.length, automaton.listed, automaton.symbols
        state = matched = 0
        last, begin = [-1], [0]  # of each prefix: its only last token, and where that token begins
        for end, symbol in enumerate(symbols, 1):
            there = following.get(state * width + symbol)
            while there is None and state:
                state = link[state]
                matched = longest[state]
                there = following.get(state * width + symbol)
            state, matched = (0, 0) if there is None else (there, matched + 1)
            found, start = -1, 0
            for n, length in listed[state] or automaton.tokens(state):
                if length <= matched:
                    start = end - length
                    token = ids_of[n]
                    if start == 0:
                        found = token
                        break
                    before = last[start]
                    if before >= 0:
                        ok = known.get(before << 20 | token)
                        if fits(before, token) if ok is None else ok:
                            found = token
                            break
            last.append(found)
            begin.append(start)
        at, ids = len(symbols), []
        while at:
            ids.append(last[at])
            at = begin[at]
        return ids[::-1]

    def decode(self, ids: list[int]) -> str:
        """What a tokenizer without a decoder gives: the tokens' names with blanks between."""
        return " ".join(self.names[i] for i in ids if i in self.names)


@lru_cache(2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def _ranges(points: list[int]) -> str:
    """A character class's inside that lists the code points as ranges."""
    out, first = [], 0
    for i, p in enumerate(points):
        if i + 1 == len(points) or points[i + 1] != p + 1:
            out.append(f"\\U{points[first]:08x}-\\U{p:08x}")
            first = i + 1
    return "".join(out)


@lru_cache(1)
def library_tables() -> tuple[str, str, dict[int, str]]:
    """Letters and numbers as the tokenizers library's expressions know them, and what its normaliser makes of code points that this Python's tables don't have.

    The library's Unicode version is neither that of `unicodedata` nor that of the regex module, so its own classes are read once a process.
    """
    from tokenizers import Regex, normalizers, pre_tokenizers

    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    every = "".join(map(chr, points))

    def class_of(expression: str) -> str:
        found = pre_tokenizers.Split(Regex(expression), "removed", invert=True).pre_tokenize_str(every)
        return _ranges([p for _, (a, b) in found for p in points[a:b]])

    unknown = [c for c in points if unicodedata.category(chr(c)) == "Cn"]
    lower = normalizers.Sequence([normalizers.NFC(), normalizers.Lowercase()])
    made = lower.normalize_str("\n".join(map(chr, unknown))).split("\n")
    return class_of(r"\p{L}"), class_of(r"\p{N}"), {c: m for c, m in zip(unknown, made) if m != chr(c)}


class WordBPE:
    """Encodes and decodes whole texts with a lower-casing vocabulary of words with end marks."""

    def __init__(self, path: str) -> None:
        self.vocabulary = vocabulary(path)
        self.table: dict[str, tuple[int, str, str]] = {}
        self.older: dict[str, tuple[int, str, str]] = {}
        self.special = re.compile("(" + "|".join(map(re.escape, sorted(self.vocabulary.special, key=len, reverse=True))) + ")")
        #: Splitting expression of the vocabulary file, its classes written out; compiled when a text needs it.
        self.all_words: re.Pattern | None = None
        #: The same for texts of ASCII, Latin-1 and Latin Extended-A characters, whose classes can be listed.
        latin = "a-zA-Z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-ſ"
        number = "0-9\xb2\xb3\xb9\xbc-\xbe"
        self.plain = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{latin}]+|[{number}]|[^\t-\r \x85\xa0{latin}{number}]+")
        self.odd = re.compile("[^\x00-\u017f]")

    @property
    def words(self) -> re.Pattern:
        if self.all_words is None:
            letter, number, _ = library_tables()
            self.all_words = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{letter}]+|[{number}]|[^{SPACE}{letter}{number}]+")
        return self.all_words

    def _word(self, word: str) -> tuple[int, str, str]:
        """What the table doesn't have; words still in use pass from the older half of the table to the younger."""
        known = self.older.pop(word, None)
        if known:
            self.table[word] = known
            return known
        ids = self.vocabulary.encode_word(word)
        if len(self.table) >= TABLE // 2:
            self.older, self.table = self.table, {}
        self.table[word] = found = (len(ids), " ".join(map(str, ids)), self.vocabulary.decode(ids))
        return found

    def parts(self, text: str) -> list[tuple[int, str, str]]:
        """(number of ids, the ids, the decoded text) of each word or special token in order."""
        found: list[tuple[int, str, str]] = []
        for n, piece in enumerate(self.special.split(text)):
            if n % 2:
                token = self.vocabulary.special[piece]
                found.append((1, str(token), self.vocabulary.decode([token])))
                continue
            # lower case without regard to the place in a word: a final capital sigma is no exception here
            plain = unicodedata.normalize("NFC", piece).replace("Σ", "σ").lower()
            if self.odd.search(plain):
                plain = plain.translate(library_tables()[2])
                words = self.words.findall(plain)
            else:
                words = self.plain.findall(plain)
            make = self._word
            found.extend(self.table.get(w) or make(w) for w in words)
        return found

    def digest(self, text: str) -> tuple[int, str, str]:
        parts = self.parts(text)
        ids, decoded = " ".join(p[1] for p in parts), " ".join(p[2] for p in parts)
        return sum(p[0] for p in parts), hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()

    def encode(self, text: str) -> list[int]:
        return [int(i) for p in self.parts(text) for i in p[1].split()]


@lru_cache(2)
def word_bpe(path: str) -> WordBPE:
    return WordBPE(path)


def encode(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids array<int>, decoded string) of every text; null and empty texts have no ids and decode to ''."""

    def maker():
        coder = word_bpe(path)

        def work(texts: list[str]) -> list[list]:
            ids = [coder.encode(t) for t in texts]
            return [ids, [coder.vocabulary.decode(x) for x in ids]]

        return work

    return map_texts(text_rows(docs), maker, "ids array<int>, decoded string")


def encode_digests(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of encode(), without moving the ids; one row for each row of docs,
    repeated rows and rows without doc_id included. Memory: one Arrow batch of texts and a bounded table of words."""

    def maker():
        coder = word_bpe(path)
        return lambda texts: list(map(list, zip(*map(coder.digest, texts)))) or [[], [], []]

    return map_texts(text_rows(docs), maker, "n_tokens bigint, ids_sha256 string, decoded_sha256 string")
