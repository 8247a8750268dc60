"""Secret scans with inferred grammars.

Three fixed patterns find credentials that are labelled by what stands around or in them. A credential's shape is its
runs of characters of one alphabet (lower-case hex digits, capitals and digits, ...) with their lengths. The prefix tree
of each kind's shapes is folded into a probabilistic automaton: states whose outgoing frequencies, and those of all
states behind them, the Hoeffding bound can't tell apart are merged (the ALERGIA procedure); states that few values reached
stay apart. Every long token of every text is then scored: it is a secret if an automaton accepts its shape, and makes it
likelier by some nats than the pairs of runs that ordinary tokens of all documents have. A shape that no labelled value
has led to is never one, however rare it is in ordinary text.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marquee.llm.common import discard, map_arrow, map_texts, materialise, text_rows

#: The kinds in their order, and their patterns.
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
KEYWORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")

#: Spans that the automata add.
LEARNED = "format"
TOKEN = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
#: Ordinary tokens, whose shapes are counted in all documents.
ORDINARY = re.compile(r"[A-Za-z0-9+/_=-]{8,}")
PLACEHOLDER = "[SECRET]"
#: Values of a kind that its automaton is fitted on at most: those of smallest hash among all documents' values.
VALUES = 400
#: Confidence of the test that keeps two states apart, and values of each that it needs.
ALPHA, LEAST = 0.05, 8
#: Nats that a candidate must gain.
GAIN = 5.0
#: Symbols that can occur, about: alphabets, lengths and signs; each counts half a time more than seen.
SYMBOLS = 80
#: How many times a symbol's own frequency counts beside those behind its neighbour.
BACKOFF = 20.0


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the fixed patterns' matches, leftmost and non-overlapping per kind, too short ones dropped."""
    found = []
    folded = text.encode("utf-8", "replace").lower()
    if any(k in folded for k in KEYWORDS):
        found += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


def value_of(text: str, span: tuple[int, int, str]) -> str:
    """The credential itself: behind the sign for an assignment."""
    value = text[span[0] : span[1]]
    return ASSIGN.match(value)[2] if span[2] == "assign" else value


RUNS = re.compile(r"[A-Za-z0-9]+|[^A-Za-z0-9]")
#: Alphabets of a run, the narrowest that holds it counts.
ALPHABETS = [("d", re.compile(r"[0-9]+")), ("a", re.compile(r"[a-z]+")), ("A", re.compile(r"[A-Z]+")), ("h", re.compile(r"[0-9a-f]+")), ("H", re.compile(r"[0-9A-F]+")), ("l", re.compile(r"[0-9a-z]+")), ("U", re.compile(r"[0-9A-Z]+")), ("m", re.compile(r"[A-Za-z]+")), ("x", re.compile(r"[0-9A-Za-z]+"))]


def _length(n: int) -> str:
    """A run's length as a symbol: itself up to 16, beyond that its half octave (16 to 23, 24 to 31, 32 to 47, ...)."""
    if n <= 16:
        return str(n)
    low = 1 << (n.bit_length() - 1)
    return f"{low + low // 2 if n >= low + low // 2 else low}+"


def shape(value: str) -> tuple[str, ...]:
    """The runs of the value: alphabet, then length, or the sign between them."""
    out = []
    for run in RUNS.findall(value):
        if run.isalnum() and run.isascii():
            n = len(run)
            out += [next(name for name, all_of in ALPHABETS if all_of.fullmatch(run)), _length(n)]
        else:
            out.append(run)
    return tuple(out)


@dataclass
class Automaton:
    """Probabilistic automaton: per state how often it was left by each symbol and how often a value ended there."""

    out: list[dict[str, int]] = field(default_factory=lambda: [{}])
    count: list[dict[str, int]] = field(default_factory=lambda: [{}])
    ends: list[int] = field(default_factory=lambda: [0])

    def add(self, symbols: tuple[str, ...]) -> None:
        at = 0
        for c in symbols:
            if c not in self.out[at]:
                self.out[at][c] = len(self.out)
                self.out.append({})
                self.count.append({})
                self.ends.append(0)
            self.count[at][c] = self.count[at].get(c, 0) + 1
            at = self.out[at][c]
        self.ends[at] += 1

    def total(self, at: int) -> int:
        return self.ends[at] + sum(self.count[at].values())

    def alike(self, a: int, b: int, alpha: float) -> bool:
        """Whether the Hoeffding bound lets both states, and all that follow them, have the same frequencies."""
        stack, seen = [(a, b)], set()
        while stack:
            pair = stack.pop()
            if pair in seen:
                continue
            seen.add(pair)
            a, b = pair
            n, m = self.total(a), self.total(b)
            if min(n, m) < LEAST:
                # too few values to tell: such states are alike only if nothing but one and the same can follow
                if self.out[a].keys() != self.out[b].keys() or bool(self.ends[a]) != bool(self.ends[b]):
                    return False
                stack += [(self.out[a][c], self.out[b][c]) for c in self.out[a]]
                continue
            most = math.sqrt(0.5 * math.log(2 / alpha)) * (1 / math.sqrt(n) + 1 / math.sqrt(m))
            if abs(self.ends[a] / n - self.ends[b] / m) > most:
                return False
            for c in self.count[a].keys() | self.count[b].keys():
                if abs(self.count[a].get(c, 0) / n - self.count[b].get(c, 0) / m) > most:
                    return False
            stack += [(self.out[a][c], self.out[b][c]) for c in self.out[a].keys() & self.out[b].keys()]
        return True

    def fold(self, into: int, tree: int) -> None:
        """Add the tree below `tree` to the states from `into` on."""
        stack = [(into, tree)]
        while stack:
            a, b = stack.pop()
            self.ends[a] += self.ends[b]
            for c, below in self.out[b].items():
                self.count[a][c] = self.count[a].get(c, 0) + self.count[b][c]
                if c in self.out[a]:
                    stack.append((self.out[a][c], below))
                else:
                    self.out[a][c] = below

    def merge_alike(self, alpha: float) -> None:
        red, blue = [0], list(self.out[0].items())
        edges = [(0, c) for c, _ in blue]
        while edges:
            edges.sort(key=lambda e: -self.total(self.out[e[0]][e[1]]))
            of, c = edges.pop(0)
            tree = self.out[of][c]
            if tree in red:
                continue
            into = next((r for r in red if self.alike(r, tree, alpha)), None)
            if into is None:
                red.append(tree)
            else:
                self.out[of][c] = into
                self.fold(into, tree)
            edges = [(r, s) for r in red for s, below in self.out[r].items() if below not in red]
        kept = {r: i for i, r in enumerate(red)}
        self.out = [{c: kept[t] for c, t in self.out[r].items()} for r in red]
        self.count = [self.count[r] for r in red]
        self.ends = [self.ends[r] for r in red]

    def likelihood(self, symbols: tuple[str, ...]) -> float:
        """Log-likelihood of the symbols and that the value ends there; minus infinity for what the automaton doesn't accept."""
        at = 0
        got = 0.0
        for c in symbols:
            if c not in self.out[at]:
                return -math.inf
            got += math.log(self.count[at][c] / self.total(at))
            at = self.out[at][c]
        return got + math.log(self.ends[at] / self.total(at)) if self.ends[at] else -math.inf


def _pairs(symbols: tuple[str, ...]) -> Iterator[tuple[str, str]]:
    return zip(("^", *symbols), (*symbols, "$"))


@dataclass
class Formats:
    """Automata of the kinds, and how often ordinary tokens have each pair of neighbouring symbols."""

    automata: dict[str, Automaton]
    ordinary: dict[tuple[str, str], int]
    first: dict[str, int]
    second: dict[str, int]

    def background(self, symbols: tuple[str, ...]) -> float:
        """Log-likelihood of the symbols as an ordinary token: a symbol behind another by how often both met, and by its own frequency where they seldom did."""
        total = sum(self.second.values())
        got = 0.0
        for a, b in _pairs(symbols):
            alone = (self.second.get(b, 0) + 0.5) / (total + SYMBOLS / 2)
            got += math.log((self.ordinary.get((a, b), 0) + BACKOFF * alone) / (self.first.get(a, 0) + BACKOFF))
        return got

    def gain(self, value: str) -> float:
        """Nats by which the best automaton that accepts the value's shape beats ordinary tokens; minus infinity if none does."""
        symbols = shape(value)
        best = max((a.likelihood(symbols) for a in self.automata.values()), default=-math.inf)
        return best - self.background(symbols) if best > -math.inf else best


def learn(values: list[tuple[str, str]], ordinary: list[str] | dict[tuple[str, str], int], alpha: float = ALPHA) -> Formats:
    """Formats of (kind, value) pairs against ordinary tokens, or counts of their pairs of symbols."""
    if not isinstance(ordinary, dict):
        ordinary = Counter(p for token in ordinary for p in _pairs(shape(token)))
    automata = {}
    for kind in KINDS:
        own = [shape(v) for k, v in sorted(values) if k == kind]
        if own:
            automata[kind] = Automaton()
            for v in own:
                automata[kind].add(v)
            automata[kind].merge_alike(alpha)
    first: Counter = Counter()
    second: Counter = Counter()
    for (a, b), n in ordinary.items():
        first[a] += n
        second[b] += n
    return Formats(automata, dict(ordinary), dict(first), dict(second))


def _uncovered(text: str, spans: list[tuple[int, int, str]], token: re.Pattern) -> Iterator[re.Match]:
    """The text's tokens that touch none of the spans (sorted by start), in one sweep."""
    at, end = 0, 0
    for m in token.finditer(text):
        while at < len(spans) and spans[at][0] < m.end():
            end = max(end, spans[at][1])
            at += 1
        if end <= m.start():
            yield m


def fit(docs: DataFrame, values: int = VALUES) -> Formats:
    """Formats learned from at most `values` different values of each kind, those of smallest hash in all documents, and from all ordinary tokens of all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: Counter = Counter()
            tokens: Counter = Counter()
            for text in batch.column("text").to_pylist():
                spans = base_spans(text)
                found.update((s[2], value_of(text, s)) for s in spans)
                tokens.update(m[0] for m in _uncovered(text, spans, ORDINARY))
            for token, n in tokens.items():
                for a, b in _pairs(shape(token)):
                    found["", f"{a} {b}"] += n
            kinds, names = zip(*found) if found else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.string()), pa.array(names, pa.string()), pa.array(found.values(), pa.int64())], names=["kind", "value", "n"])

    counted = materialise(map_arrow(text_rows(docs), run, "kind string, value string, n bigint").groupBy("kind", "value").agg(F.sum("n").alias("n")))
    pairs = {tuple(r["value"].split(" ")): r["n"] for r in counted.where("kind = ''").collect()}
    order = Window.partitionBy("kind").orderBy(F.xxhash64("value"), "value")
    kept = counted.where("kind <> ''").select("kind", "value", F.row_number().over(order).alias("r")).where(F.col("r") <= values).collect()
    discard(counted)
    return learn([(r["kind"], r["value"]) for r in kept], pairs)


def all_spans(text: str, formats: Formats, gain: float = GAIN) -> list[tuple[int, int, str]]:
    """The fixed patterns' spans and those of other tokens with a digit and a letter whose shape an automaton accepts and finds likely."""
    spans = base_spans(text)
    added = []
    for m in _uncovered(text, spans, TOKEN):
        value = m[0]
        if any(c.isdigit() for c in value) and any(c.isalpha() for c in value) and formats.gain(value) >= gain:
            added.append((m.start(), m.end(), LEARNED))
    return sorted(spans + added, key=lambda s: (s[0], (*KINDS, LEARNED).index(s[2])))


def _written(spans: Iterator[tuple[int, int, str]] | list) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def scan(docs: DataFrame, formats: Formats | None = None) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) of every text; a null or empty text has no spans.

    One row for each row of docs. Positions count code points, ends are exclusive. Tokens of any length are scored
    and reported whole.
    """
    known = formats or fit(docs)

    def maker():
        def work(texts: list[str]) -> list[list]:
            rows = []
            for text in texts:
                spans = all_spans(text, known)
                base = [s for s in spans if s[2] != LEARNED]
                n = Counter(s[2] for s in base)
                rows.append((n["assign"], n["access"], n["hex"], hashlib.sha256(_written(base).encode()).hexdigest(), _written(spans)))
            return list(map(list, zip(*rows))) or [[]] * 5

        return work

    return map_texts(text_rows(docs), maker, "n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string")


def redacted(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with each run of touching or overlapping spans replaced by the placeholder."""
    parts, at = [], 0
    for start, end, _ in spans:
        if start > at or at == 0:
            parts += [text[at:start], PLACEHOLDER]
        at = max(at, end)
    return "".join(parts) + text[at:]


def redact(docs: DataFrame, formats: Formats | None = None) -> DataFrame:
    """docs with the secrets in `text` replaced by a placeholder; null text stays null, other columns pass through.

    Empty texts stay empty, repeated rows are redacted alike, and spans that touch or overlap leave one placeholder.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    known = formats or fit(docs)
    schema = to_arrow_schema(docs.schema)
    where = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            texts = [t if t is None else redacted(t, all_spans(t, known)) for t in batch.column(where).to_pylist()]
            columns = [pa.array(texts, schema.field(i).type) if i == where else c.cast(schema.field(i).type) for i, c in enumerate(batch.columns)]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return map_arrow(docs, run, docs.schema)
