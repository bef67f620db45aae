"""Secret scan by one deterministic automaton for all rules, run over the bytes once.

Every rule's regex is parsed to an NFA; the union goes through subset construction and
minimisation into one transition array over byte classes. A slice of texts is cut into lanes that
step through the array together. A lane starts from a guessed state, and lanes whose left
neighbour ended elsewhere run again until all agree, so the result is that of one pass.

A match of a rule is leftmost and as long as possible, not overlapping the rule's earlier ones.
Where the pass sees a rule accept, the match's start comes from the rule's reversed automaton and
its end from the anchored one. This needs rules in which a match that starts earlier is also
complete earlier, which holds for every rule here.

Edge cases: null and empty texts have no spans; offsets count code points, end exclusive; repeated
rows each give a row; an empty table gives an empty table; only the two named columns are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .arrow import slices, thrifty

#: Never part of UTF-8 text: ends one text and begins the next.
BREAK = 0xFF


@dataclass(frozen=True)
class Rule:
    """A kind of secret; matches whose value (what follows the last separator) or whole is shorter are dropped."""

    kind: str
    regex: str
    fold: bool = False
    min_value: int = 0
    min_length: int = 0


#: The rules of the contract, as minimum lengths of the whole match or, for assign, of its value.
BASE = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+""", True, 6),
    Rule("access", r"AKIA[A-Z0-9]+", min_length=20),
    Rule("hex", r"[0-9a-f]{24,}"),
)
#: Published shapes of further credentials. Open runs with a minimum length, as a counted run that
#: may start anew inside itself has exponentially many states.
EXTRA = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", min_length=40),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", min_length=15),
    Rule("google", r"AIza[A-Za-z0-9_-]+", min_length=39),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
)


class _Nfa:
    """Thompson construction over bytes for: literals, classes, groups, |, ?, *, +, {n,}, {n}, \\xHH."""

    def __init__(self):
        self.edges: list[list[tuple[frozenset[int], int]]] = []
        self.empty: list[list[int]] = []

    def state(self) -> int:
        self.edges.append([])
        self.empty.append([])
        return len(self.edges) - 1

    def build(self, regex: str, fold: bool, reverse: bool = False) -> tuple[int, int]:
        self.text, self.at, self.fold, self.reverse = regex, 0, fold, reverse
        node = self._alternatives()
        if self.at != len(regex):
            raise ValueError(f"can't read {regex!r} at {self.at}")
        return self._make(node)

    def _peek(self) -> str:
        return self.text[self.at : self.at + 1]

    def _alternatives(self):
        options = [self._sequence()]
        while self._peek() == "|":
            self.at += 1
            options.append(self._sequence())
        return ("or", options)

    def _sequence(self):
        parts = []
        while self._peek() not in ("", "|", ")"):
            node = self._atom()
            while self._peek() in ("?", "*", "+", "{") and self._peek():
                c = self._peek()
                self.at += 1
                if c == "{":
                    end = self.text.index("}", self.at)
                    low, comma, high = self.text[self.at : end].partition(",")
                    self.at = end + 1
                    node = ("repeat", node, int(low), None if comma and not high else int(high or low))
                else:
                    node = ("repeat", node, int(c == "+"), 1 if c == "?" else None)
            parts.append(node)
        return ("and", parts)

    def _char(self) -> int:
        c = self.text[self.at]
        self.at += 1
        if c == "\\":
            c = self.text[self.at]
            self.at += 1
            if c == "x":
                self.at += 2
                return int(self.text[self.at - 2 : self.at], 16)
        return ord(c)

    def _bytes(self, found: set[int]):
        if self.fold:
            found |= {b ^ 32 for b in found if 65 <= b & ~32 <= 90}
        return ("byte", frozenset(found))

    def _atom(self):
        c = self._peek()
        if c == "(":
            self.at += 1
            node = self._alternatives()
            self.at += 1
            return node
        if c == "[":
            self.at += 1
            found: set[int] = set()
            while self._peek() != "]":
                low = self._char()
                if self._peek() == "-" and self.text[self.at + 1] != "]":
                    self.at += 1
                    found |= set(range(low, self._char() + 1))
                else:
                    found.add(low)
            self.at += 1
            return self._bytes(found)
        return self._bytes({self._char()})

    def _make(self, node) -> tuple[int, int]:
        kind = node[0]
        a, b = self.state(), self.state()
        if kind == "byte":
            self.edges[a].append((node[1], b))
        elif kind == "or":
            for option in node[1]:
                x, y = self._make(option)
                self.empty[a].append(x)
                self.empty[y].append(b)
        elif kind == "and":
            at = a
            for part in reversed(node[1]) if self.reverse else node[1]:
                x, y = self._make(part)
                self.empty[at].append(x)
                at = y
            self.empty[at].append(b)
        else:
            _, inner, low, high = node
            at = a
            for _ in range(low):
                x, y = self._make(inner)
                self.empty[at].append(x)
                at = y
            if high is None:
                x, y = self._make(inner)
                self.empty[at] += [x, b]
                self.empty[y] += [x, b]
            else:
                self.empty[at].append(b)
                for _ in range(high - low):
                    x, y = self._make(inner)
                    self.empty[at].append(x)
                    self.empty[y].append(b)
                    at = y
        return a, b


class Dfa:
    """Minimal automaton: step[state, class], accept[state] as a bit mask of rules. State 0 is the start."""

    def __init__(self, rules: list[Rule], search: bool, reverse: bool = False):
        nfa, starts, ends = _Nfa(), [], {}
        for k, r in enumerate(rules):
            a, b = nfa.build(r.regex, r.fold, reverse)
            starts.append(a)
            ends[b] = ends.get(b, 0) | 1 << k
        classes: dict[tuple, int] = {}
        sets = list({s for e in nfa.edges for s, _ in e})
        self.class_of = np.array([classes.setdefault(tuple(b in s for s in sets), len(classes)) for b in range(256)], np.uint8)
        sample = {int(c): b for b, c in reversed(list(enumerate(self.class_of.tolist())))}

        def close(states):
            todo, seen = list(states), set(states)
            while todo:
                for x in nfa.empty[todo.pop()]:
                    if x not in seen:
                        seen.add(x)
                        todo.append(x)
            return frozenset(seen)

        first = close(starts)
        number, order, rows = {first: 0}, [first], []
        for states in order:  # grows while it is walked
            row = []
            for c in range(len(classes)):
                to = {y for x in states for s, y in nfa.edges[x] if sample[c] in s}
                nxt = close(to) | (first if search else frozenset())
                if nxt not in number:
                    number[nxt] = len(order)
                    order.append(nxt)
                row.append(number[nxt])
            rows.append(row)
        accept = [0] * len(order)
        for i, states in enumerate(order):
            for x in states:
                accept[i] |= ends.get(x, 0)
        step, accept = self._minimise(np.array(rows), np.array(accept))
        self.accept = accept
        self.step = np.ascontiguousarray(step)
        self.dead = next((i for i in range(len(accept)) if not accept[i] and (step[i] == i).all()), -1)
        self.table = [[int(x) for x in row[self.class_of]] for row in step]

    @staticmethod
    def _minimise(step: np.ndarray, accept: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Moore's refinement: states stay together while their accept masks and successors' blocks agree."""
        block = np.unique(accept, return_inverse=True)[1].reshape(-1)
        while True:
            new = np.unique(np.column_stack([block, block[step]]), axis=0, return_inverse=True)[1].reshape(-1)
            if new.max() == block.max():
                break
            block = new
        # number blocks so that the start is 0
        order = np.full(block.max() + 1, -1)
        n = 0
        for b in [block[0], *block]:
            if order[b] < 0:
                order[b] = n
                n += 1
        block = order[block]
        where = np.zeros(n, int)
        where[block] = np.arange(len(block))
        return block[step[where]], accept[where]

    def longest(self, data: bytes, at: int, limit: int, direction: int) -> int | None:
        """Farthest position at which it accepts, walking from at towards limit; None if it never does."""
        s, found = 0, None
        if direction > 0:
            for i in range(at, limit):
                s = self.table[s][data[i]]
                if s == self.dead:
                    break
                if self.accept[s]:
                    found = i + 1
        else:
            for i in range(at - 1, limit - 1, -1):
                s = self.table[s][data[i]]
                if s == self.dead:
                    break
                if self.accept[s]:
                    found = i
        return found


class Scanner:
    def __init__(self, rules: tuple[Rule, ...]):
        self.rules = list(rules)
        self.all = Dfa(self.rules, search=True)
        self.ahead = [Dfa([r], search=False) for r in rules]
        self.back = [Dfa([r], search=False, reverse=True) for r in rules]
        # flat array with a class of its own for the break, which leads back to the start
        n, c = self.all.step.shape
        self.width = c + 1
        flat = np.zeros((n, self.width), np.int32)
        flat[:, :c] = self.all.step * self.width
        self.flat = flat.reshape(-1)
        self.class_of = self.all.class_of.astype(np.uint8).copy()
        self.class_of[BREAK] = c
        self.accept = self.all.accept

    def states(self, data: np.ndarray, lanes: int = 2048) -> np.ndarray:
        """State after each byte, as if read from the first to the last in one go."""
        n = len(data)
        width = max(64, -(-n // lanes))
        rows = -(-n // width)
        classes = np.full(rows * width, self.width - 1, np.int32)
        classes[:n] = self.class_of[data]
        classes = np.ascontiguousarray(classes.reshape(rows, width).T)
        out = np.empty((width, rows), np.int32)
        begin = np.zeros(rows, np.int32)
        todo = np.arange(rows)
        while len(todo):
            s = begin[todo]
            if len(todo) == rows:
                for t in range(width):
                    s = self.flat[s + classes[t]]
                    out[t] = s
            else:
                live = np.ones(len(todo), bool)
                for t in range(width):  # until the lane falls in with what it had
                    s[live] = self.flat[s[live] + classes[t, todo[live]]]
                    live &= out[t, todo] != s
                    if not live.any():
                        break
                    out[t, todo[live]] = s[live]
            should = np.concatenate([[0], out[-1, :-1]]).astype(np.int32)
            todo = np.flatnonzero(should != begin)
            begin = should
        return (out.T.reshape(-1)[:n]) // self.width

    def spans(self, data: bytes, hits: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
        """(start, rule, end) in bytes from the (position, mask) pairs at which the pass accepts."""
        found = []
        for k, rule in enumerate(self.rules):
            done = 0
            for at, mask in hits:
                if not mask >> k & 1 or at < done:
                    continue
                start = self.back[k].longest(data, at + 1, done, -1)
                if start is None:
                    continue
                end = self.ahead[k].longest(data, start, len(data), 1)
                done = end
                if end - start >= rule.min_length and (not rule.min_value or self._value(data[start:end]) >= rule.min_value):
                    found.append((start, k, end))
        return sorted(found)

    @staticmethod
    def _value(match: bytes) -> int:
        """Length of the value of an assignment: what follows its first separator, blanks and quote."""
        at = min(i for i in (match.find(b":"), match.find(b"=")) if i >= 0) + 1
        rest = match[at:].lstrip(b" ")
        return len(rest) - (rest[:1] in (b'"', b"'"))

    def scan(self, data: np.ndarray, bounds: np.ndarray) -> list[list[tuple[int, int, int]]]:
        """Spans of each text that bounds delimit, in code points."""
        n = len(bounds) - 1
        joined = np.full(len(data) + n, BREAK, np.uint8)
        shift = np.arange(n)
        owner = np.repeat(shift, np.diff(bounds))
        joined[np.arange(len(data)) + owner] = data
        mask = self.accept[self.states(joined)] if len(joined) else np.zeros(0, int)
        at = np.flatnonzero(mask)
        begins = bounds[:-1] + shift
        which = np.searchsorted(begins, at, "right") - 1
        out: list[list[tuple[int, int, int]]] = [[] for _ in range(n)]
        edges = np.append(np.flatnonzero(np.diff(which, prepend=-1)), len(at))
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            i = which[a]
            text = data[bounds[i] : bounds[i + 1]]
            spans = self.spans(text.tobytes(), list(zip((at[a:b] - begins[i]).tolist(), mask[at[a:b]].tolist(), strict=True)))
            points = np.concatenate([[0], np.cumsum((text & 0xC0) != 0x80)])
            out[i] = [(int(points[s]), k, int(points[e])) for s, k, e in spans]
        return out


_SCANNERS: dict[tuple[Rule, ...], Scanner] = {}


def scanner(rules: tuple[Rule, ...]) -> Scanner:
    if rules not in _SCANNERS:
        _SCANNERS[rules] = Scanner(rules)
    return _SCANNERS[rules]


def _named(spans, rules) -> str:
    return ",".join([f"{rules[k].kind}:{a}:{b}" for a, k, b in spans])


def scan_table(df: DataFrame, base: tuple[Rule, ...] = BASE, extra: tuple[Rule, ...] = EXTRA, id_col="doc_id", text_col="text") -> DataFrame:
    """Per text: counts n_<kind> of the base rules, base_sha256 of their spans, and spans of all rules."""
    rules = (*base, *extra)
    names = [f"n_{r.kind}" for r in base]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = scanner(rules)
        for piece in slices(batches):
            found = s.scan(piece.data, piece.bounds)
            counts = np.zeros((len(base), len(found)), np.int64)
            digests, spans = [], []
            none = hashlib.sha256(b"").hexdigest()
            for i, x in enumerate(found):
                own = [y for y in x if y[1] < len(base)]
                for _, k, _ in own:
                    counts[k, i] += 1
                digests.append(hashlib.sha256(_named(own, rules).encode()).hexdigest() if own else none)
                spans.append(_named(x, rules))
            yield pa.RecordBatch.from_arrays([piece.ids, *map(pa.array, counts), pa.array(digests), pa.array(spans)], names=["id", *names, "base_sha256", "spans"])

    kind = df.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, {', '.join(f'{n} long' for n in names)}, base_sha256 string, spans string"
    return df.select(id_col, text_col).mapInArrow(thrifty(run), schema).withColumnRenamed("id", id_col)


def mask_table(df: DataFrame, text_col: str = "text", base: tuple[Rule, ...] = BASE, extra: tuple[Rule, ...] = EXTRA, mark: str = "[{}]") -> DataFrame:
    """All columns, with every secret in the text replaced by a mark naming its kind; overlapping spans become one."""
    rules = (*base, *extra)
    names = df.columns
    at = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = scanner(rules)
        for batch in batches:
            for piece in slices([pa.RecordBatch.from_arrays([pa.array(np.arange(batch.num_rows)), batch.column(at)], names=["i", "t"])]):
                rows = batch.slice(piece.ids[0].as_py(), len(piece))
                texts = rows.column(at).to_pylist()
                for i, spans in enumerate(s.scan(piece.data, piece.bounds)):
                    if spans:
                        out, done = [], 0
                        for a, k, b in spans:
                            if a >= done:
                                out += [texts[i][done:a], mark.format(rules[k].kind)]
                            done = max(done, b)
                        texts[i] = "".join([*out, texts[i][done:]])
                columns = list(rows.columns)
                columns[at] = pa.array(texts, batch.schema.types[at])
                yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return df.mapInArrow(thrifty(run), df.schema)
