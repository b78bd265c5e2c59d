"""What follows from the tokens of whole files, for many files at once, by arrays in a worker.

Siblings (tokens beside each other within one bracket), chains, functions, declarations and bindings,
sums, fields, calls and needs all stay within a file, so a worker that has the file's tokens tells
them without a shuffle or a sort of tokens by Spark. A token is known here by its number among the
tokens of all files given at once; ``none`` stands for no token, wherever a lag or a join had a null.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Callable, Iterator
from functools import cache, cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.operators.calls import KEYWORDS
from loomspark.operators.nesting import held
from loomspark.operators.tokens import KINDS, files_of, found_in, kind_of, numbered, parts_of, stacks

#: Tokens that a worker takes at once, unless one file has more.
AT_ONCE = 1 << 17
#: The scope of the file itself, no scope, and the last place of a file.
FILE, FREE, END = -1, -2, (1 << 30) - 1
#: Why a variable or a request has no value.
MANY, WRITTEN, NO_SUM, NO_VALUE, NO_URL = "declared more than once", "written to later", "not a sum of strings and names", "needs a name that has no value", "no url"
#: A value longer than this many characters is none: sums of sums double.
LONGEST = 10_000
#: Signs and words after which a function is an expression, words that end a list of declared names, and words that are names of no variable.
EXPRESSION = ("=", ",", ":", "?", "&", "|", "!", "+", "-", "*", "/", "%", "<", ">", "~", "=>", "return", "new", "typeof", "void", "delete", "in", "of", "instanceof", "throw", "case", "yield", "await", "async")
STATEMENT = ("var", "let", "const", ";", "if", "for", "while", "return", "switch", "throw", "try", "do", "else", "break", "continue")
NO_VARIABLE = (*KEYWORDS, "this", "null", "true", "false", "undefined", "super", "async", "await", "of", "static", "get", "set")
#: Signs that write to the name before them, those that assign alone, words that go on with an expression, and words that declare a variable.
WRITES = re.compile(r"=(?![=>])|(?:\*\*|<<|>>>?|&&|\|\||\?\?|[-+*/%&|^])=(?!=)|\+\+|--")
ASSIGNS = re.compile(r"=(?![=>])")
GOING_ON = ("in", "instanceof", "of")
VARIABLES = ("var", "let", "const")
FUNCTIONS = ("function", "declaration", "method", "arrow")
NAMES, STRINGS, TEMPLATES, NUMBERS, PATTERNS = (KINDS.index(k) for k in ("name", "string", "template", "number", "pattern"))
#: The words that are told apart, by number; all others are 0.
WORDS = {w: k for k, w in enumerate(dict.fromkeys((*EXPRESSION, *STATEMENT, *NO_VARIABLE, *"()[]{}.,;")), 1)}


@cache
def table(words: tuple[str, ...]) -> np.ndarray:
    found = np.zeros(len(WORDS) + 1, bool)
    found[[WORDS[w] for w in words]] = True
    return found


def text_of(kind: int, text: str) -> str | None:
    """What a token says as a string; None if it is none or is not plain."""
    if kind == STRINGS:
        return None if re.search(r"\\[^'\"\\]", text) else re.sub(r"\\(['\"\\])", r"\1", text[1:-1])
    return text[1:-1] if kind == TEMPLATES and "\\" not in text and "${" not in text else None


class Files:
    """Tokens of files, one file after the other: offsets, lines, kinds, texts, and brackets by the token's place in its file (-1 for none)."""

    def __init__(self, counts, start, line, kind, codes, words, partner, parent):
        n = self.none = len(codes)
        self.counts, self.of = counts, np.append(np.repeat(np.arange(len(counts)), counts), 0)
        self.first = (np.cumsum(counts) - counts)[self.of] if n else np.zeros(1, np.int64)
        self.start, self.line = np.append(start, -10), np.append(line, 1 << 30)
        self.kind, self.codes, self.words = np.append(kind, -1), np.append(codes, len(words)), [*words, ""]
        self.special = np.fromiter((WORDS.get(w, 0) for w in self.words), np.int64, len(self.words))[self.codes]
        first = self.first[:n]
        self.partner, self.parent = (np.append(np.where(x < 0, n, first + x), n) for x in (partner, parent))
        group = np.where(parent < 0, n + self.of[:n], first + parent)
        self.order = np.argsort(group, kind="stable")
        place, sorted_ = np.arange(n), group[self.order]
        begins = np.append(True, sorted_[1:] != sorted_[:-1])[:n]
        self.at = np.full(n + 1, n)
        self.at[self.order] = place
        self.group_head = np.maximum.accumulate(np.where(begins, place, 0))
        ends = np.append(begins[1:], True)[:n]
        self.group_end = np.minimum.accumulate(np.where(ends, place + 1, n)[::-1])[::-1]
        self.before, self.after = np.full(n + 1, n), np.full(n + 1, n)
        self.before[self.order[1:]] = np.where(begins[1:], n, self.order[:-1])
        self.after[self.order[:-1]] = np.where(begins[1:], n, self.order[1:])

    @cached_property
    def all(self) -> np.ndarray:
        return np.arange(self.none + 1)

    def lag(self, k: int) -> np.ndarray:
        out = self.all
        for _ in range(k):
            out = self.before[out]
        return out

    def lead(self, k: int) -> np.ndarray:
        out = self.all
        for _ in range(k):
            out = self.after[out]
        return out

    def among(self, tokens: np.ndarray, *words: str) -> np.ndarray:
        return table(words)[self.special[tokens]]

    def word(self, token: int) -> str:
        return self.words[self.codes[token]]

    def place(self, tokens: np.ndarray) -> np.ndarray:
        return tokens - self.first[tokens]

    def last(self, marks: np.ndarray, own: bool = True) -> np.ndarray:
        """The last marked sibling up to each token, or before it."""
        n, order = self.none, self.order
        found = np.maximum.accumulate(np.where(marks[order], np.arange(n), -1))
        found = found if own else np.append(-1, found)[:n]
        out = np.full(n + 1, n)
        out[order] = np.where(found >= self.group_head, order[np.maximum(found, 0)], n)
        return out

    @cached_property
    def on(self) -> np.ndarray:
        """Whether a token goes on with the chain of members and calls before it."""
        was, kind = self.lag(1), self.kind
        ends = np.isin(kind[was], (STRINGS, TEMPLATES, PATTERNS, NUMBERS)) | self.among(was, ")", "]")
        ends |= (kind[was] == NAMES) & (~self.among(was, *KEYWORDS) | self.among(self.lag(2), "."))
        opens = self.among(self.all, "(", "[", ".")
        return np.where(opens, ends, np.where(kind == NAMES, self.among(was, "."), self.among(self.all, ")", "]")))

    @cached_property
    def over(self) -> np.ndarray:
        """Where the stretch of each token's bracket ends: before the next comma or semicolon, or with the last sibling."""
        n, order = self.none, self.order
        marked = np.minimum.accumulate(np.where(self.among(order, ",", ";"), np.arange(n), n)[::-1])[::-1]
        marked = np.append(marked, n)[1:]
        out = np.full(n + 1, n)
        out[order] = np.where(marked < self.group_end, order[np.minimum(marked, n - 1)] - 1, order[self.group_end - 1])
        return out

    @cached_property
    def around(self) -> np.ndarray:
        """The bracket around each token, if it is closed."""
        return np.where(self.partner[self.parent] < self.none, self.parent, self.none)

    @cached_property
    def functions(self) -> dict[str, np.ndarray]:
        """``start, stop, kind, name, parameters, outer`` of functions: kinds by ``FUNCTIONS``, the others tokens."""
        n, b = self.none, [self.lag(k) for k in range(6)]
        braced = np.flatnonzero(self.among(b[0], "{") & self.among(b[1], ")") & self.among(b[2], "("))
        b1, b2, b3, b4, b5 = (x[braced] for x in b[1:])
        anonymous, named = self.among(b3, "function"), self.among(b4, "function")
        letters = np.fromiter((re.match(r"[A-Za-z_$]", self.word(t)) is not None for t in b3.tolist()), bool, len(b3))
        method = ~anonymous & ~named & letters & ~self.among(b3, *KEYWORDS) & ~self.among(b4, ".", "new")
        expression = self.among(b5, *EXPRESSION) | ((b5 == n) & self.among(self.around[braced], "(", "["))
        kept = anonymous | named | method
        kind = np.where(method, FUNCTIONS.index("method"), np.where(anonymous | expression, FUNCTIONS.index("function"), FUNCTIONS.index("declaration")))
        made = (b2, self.partner[braced], kind, np.where(anonymous, n, b3), b2, self.parent[braced])
        arrows = np.flatnonzero((self.codes == self.code("=>")) & (b[1] < n))
        a1, listed = b[1][arrows], self.among(b[1][arrows], ")")
        next_ = self.after[arrows]
        start = np.where(listed, b[2][arrows], a1)
        stop = np.where(self.among(next_, "{"), self.partner[next_], self.over[arrows])
        none = np.full(len(arrows), n)
        shown = (start, stop, none * 0 + FUNCTIONS.index("arrow"), none, np.where(listed, b[2][arrows], n), self.parent[arrows])
        found = {name: np.concatenate([x[kept], y]) for name, x, y in zip(("start", "stop", "kind", "name", "parameters", "outer"), made, shown, strict=True)}
        known = found["start"] < n  # what stands behind a bracket that nothing opens has no start
        return {name: x[known] for name, x in found.items()}

    def code(self, word: str) -> int:
        return self.code_of.get(word, -1)

    @cached_property
    def code_of(self) -> dict[str, int]:
        return {w: k for k, w in enumerate(self.words[:-1])}

    def within(self, tokens: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
        """Which span each token is innermost in, -1 for none; a span that stops at ``none`` does not end."""
        return held(self.of[tokens], tokens, self.of[starts], starts, np.where(stops < self.none, stops, -1))

    def owner(self, kinds: tuple[str, ...] = FUNCTIONS) -> np.ndarray:
        """The number of the innermost function of these kinds around each token, -1 outside all."""
        f = self.functions
        which = np.flatnonzero(np.isin(f["kind"], [FUNCTIONS.index(k) for k in kinds]))
        found = self.within(self.all[:-1], f["start"][which], f["stop"][which])
        return np.append(np.where(found < 0, -1, np.append(which, -1)[found]), -1)

    @cached_property
    def owners(self) -> np.ndarray:
        return self.owner()

    @cached_property
    def declarations(self) -> dict[str, np.ndarray]:
        """``token, scope, stop, how`` of each declared name: the first and last token of what holds it (``FILE``, ``END`` for the file)."""
        n, f = self.none, self.functions
        before, after, all_ = self.lag(1), self.lead(1), self.all
        listing = np.full(n + 1, -1)
        listing[f["parameters"]] = np.arange(len(f["parameters"]))
        listing[n] = -1
        of = listing[self.parent]
        ended = np.append(np.where(f["stop"] < n, f["stop"], END), END)
        owner_held = np.append(f["start"], FILE)[self.owners]
        owner_end = ended[self.owners]
        statement = self.last(self.among(all_, *STATEMENT) & ~self.among(before, "."), own=False)
        named = (self.kind == NAMES) & ~self.among(all_, *NO_VARIABLE)
        first = (before == n) | self.among(before, ",", ".")
        in_block = self.among(self.around, "{") & (self.parent > owner_held)
        block, block_end = np.where(in_block, self.parent, owner_held), np.where(in_block, self.partner[self.parent], owner_end)
        direct = self.among(before, *VARIABLES)
        listed = direct | (self.among(before, ",") & self.among(statement, *VARIABLES))
        which = np.where(direct, before, statement)
        names = ("parameter", "bare", *VARIABLES, "class")
        variable = np.select([self.among(which, w) for w in VARIABLES], [names.index(w) for w in VARIABLES], -1)
        how = np.select([(of >= 0) & first, (self.codes[after] == self.code("=>")) & (after < n) & ~self.among(before, "."), listed, self.among(before, "class")], [0, 1, variable, names.index("class")], -1)
        t = np.flatnonzero(named & (how >= 0))
        how, of = how[t], of[t]
        cases = [how == 0, how == 1, how == names.index("var")]
        scope = np.select(cases, [np.append(f["start"], n)[of], t, owner_held[t]], block[t])
        stop = np.select(cases, [np.append(f["stop"], n)[of], self.over[t], owner_end[t]], block_end[t])
        own = np.flatnonzero((f["name"] < n) & (f["kind"] == FUNCTIONS.index("function")))
        at = f["name"][(f["name"] < n) & (f["kind"] == FUNCTIONS.index("declaration"))]
        parts = {
            "token": (t, f["name"][own], at), "scope": (scope, f["start"][own], owner_held[at]), "stop": (stop, f["stop"][own], owner_end[at]),
            "how": (np.array(names, object)[how], np.full(len(own), "own", object), np.full(len(at), "function", object)),
        }
        return {name: np.concatenate(x) for name, x in parts.items()}

    def named(self, tokens: np.ndarray) -> np.ndarray:
        """A number for the file and the text of each token."""
        return self.of[tokens] * len(self.words) + self.codes[tokens]

    def scoped(self, tokens: np.ndarray, scope: np.ndarray) -> np.ndarray:
        """A number for the file, the text and the scope of each token."""
        return self.named(tokens) * (self.none + 2) + scope + 1

    @cached_property
    def bindings(self) -> tuple[np.ndarray, np.ndarray]:
        """The names that stand for variables, and the scope that declares each (``FILE``, or ``FREE``)."""
        n, before = self.none, self.lag(1)
        key = (self.codes[self.lead(1)] == self.code(":")) & (self.lead(1) < n) & ((before == n) | self.among(before, ",", "{")) & self.among(self.around, "{")
        method = np.zeros(n + 1, bool)
        method[self.functions["name"][self.functions["kind"] == FUNCTIONS.index("method")]] = True
        used = np.flatnonzero((self.kind == NAMES) & ~self.among(self.all, *NO_VARIABLE) & ~self.among(before, ".") & ~key & ~method)
        d = self.declarations
        _, one = np.unique(np.stack([self.named(d["token"]), d["scope"], d["stop"]]), axis=1, return_index=True) if len(d["token"]) else (None, np.zeros(0, np.int64))
        stop = d["stop"][one]
        found = held(self.named(used), used, self.named(d["token"][one]), d["scope"][one], np.where(stop == n, -1, stop))
        return used, np.where(found < 0, FREE, np.append(d["scope"][one], FREE)[found])

    def signs(self, tokens: np.ndarray, pattern: re.Pattern) -> np.ndarray:
        """Whether the signs that follow a token, up to four without a gap, blanks before the first aside, begin by ``pattern``."""
        near, found, touching = tokens, [], np.ones(len(tokens), bool)
        size = np.fromiter(map(len, self.words), np.int64, len(self.words))
        for k in range(4):
            was, near = near, self.after[near]
            if k:
                touching &= self.start[near] == self.start[was] + size[self.codes[was]]
            found.append(np.where(touching, self.codes[near], len(self.words) - 1))
        known: dict[tuple, bool] = {}
        out = np.zeros(len(tokens), bool)
        for k, codes in enumerate(zip(*(x.tolist() for x in found), strict=True)):
            if (told := known.get(codes)) is None:
                told = known[codes] = pattern.match("".join([self.words[c] for c in codes])) is not None
            out[k] = told
        return out

    @cached_property
    def writes(self) -> np.ndarray:
        """Whether a token is a name that is written to after its declaration, or by it in a loop."""
        n, b1, b2 = self.none, self.lag(1), self.lag(2)
        plus, minus = self.among(b1, "+") & self.among(b2, "+"), self.among(b1, "-") & self.among(b2, "-")
        written = (plus | minus) & (self.start[b1] == self.start[b2] + 1)
        written |= self.among(self.lead(1), "in", "of")
        asked = np.flatnonzero(((self.kind == NAMES) | self.among(self.all, ")", "]", "}")) & (self.after < n))
        written[asked] |= self.signs(asked, WRITES)
        listed = np.zeros(n + 1, bool)
        listed[self.functions["parameters"]] = True
        listed[n] = False
        pattern = self.among(self.all, "[", "{") & ~self.on & (written[self.lead(1)] | listed[self.parent])
        spans = np.flatnonzero((pattern | (self.among(self.all, "(") & self.among(b1, "catch"))) & (self.partner < n) & (self.partner > self.all))
        depth = np.zeros(n + 2, np.int64)
        np.add.at(depth, spans, 1)
        np.add.at(depth, self.partner[spans] + 1, -1)
        return (self.kind == NAMES) & (written | (np.cumsum(depth)[:-1] > 0))

    @cached_property
    def said(self) -> np.ndarray:
        """What each word says as a string, None if it says none."""
        return np.array([text_of(KINDS.index(kind_of(w)), w) if w[:1] in ("'", '"', "`") and w else None for w in self.words], object)

    def sums(self, heads: np.ndarray) -> list[list[int] | None]:
        """The terms of the expression that begins at each of the tokens ``heads``; None if it is no sum of strings and names.

        An expression ends at a comma, a semicolon, the end of its bracket, or at a new line that does not go on with it.
        """
        if not len(heads):
            return []
        n, order, all_ = self.none, self.order, self.all
        begins = np.zeros(n + 1, bool)
        begins[heads] = True
        head_at = self.at[self.last(begins)[order]]  # by position: that of the expression's first token
        position = np.arange(n)
        odd = (position - head_at) % 2 == 0
        term = np.not_equal(self.said, None)[self.codes] | ((self.kind == NAMES) & ~self.among(all_, *NO_VARIABLE))
        fits = np.where(odd, term[order], self.among(order, "+"))
        new_line = (self.line > self.line[self.before]) & (np.isin(self.kind, (NAMES, STRINGS, NUMBERS)) | self.among(all_, "{", "}")) & ~self.among(all_, *GOING_ON)
        ends = ~odd & (self.among(order, ",", ";") | new_line[order])
        bad = np.minimum.accumulate(np.where(fits, n, position)[::-1])[::-1]
        next_head = np.minimum.accumulate(np.append(np.where(begins[order], position, n), n)[::-1])[::-1][1:]
        p = self.at[heads]
        until = np.minimum(next_head[p], self.group_end[p])
        stop = bad[p]
        stopped = stop < until
        stop = np.where(stopped, stop, until)
        whole = (~stopped | ends[np.minimum(stop, n - 1)]) & (stop > p) & ((stop - 1 - p) % 2 == 0)
        return [order[a:b:2].tolist() if good else None for a, b, good in zip(p.tolist(), stop.tolist(), whole.tolist(), strict=True)]

    @cached_property
    def bound(self) -> tuple[np.ndarray, np.ndarray, dict[str, np.ndarray]]:
        """The bound names, which variable each is, and the variables: ``token`` of the first declaration, its ``how``, and ``n`` of them."""
        d = self.declarations
        key = self.scoped(d["token"], d["scope"])
        order = np.lexsort((d["token"], key))
        keys, first, n = np.unique(key[order], return_index=True, return_counts=True)
        one = order[first]
        used, scope = self.bindings
        used, scope = used[scope != FREE], scope[scope != FREE]
        return used, np.searchsorted(keys, self.scoped(used, scope)), {"token": d["token"][one], "how": d["how"][one], "n": n, "key": keys}

    @cached_property
    def variables(self) -> dict:
        """Variables declared with a value: ``token`` of the declaration, why it has none that is told (``fault``), what it stands for (``value``), and what ``added_up`` asks for."""
        used, variable, known = self.bound
        token = known["token"]
        again = np.zeros(len(token), bool)
        again[variable[self.writes[used] & (used != token[variable])]] = True
        next_ = self.after[token]
        which = np.flatnonzero(np.isin(known["how"], VARIABLES) & self.among(next_, "="))
        heads = self.after[next_[which]]
        terms: list[list[int] | None] = [None] * len(which)
        there = np.flatnonzero(heads < self.none)
        for k, found in zip(there.tolist(), self.sums(heads[there]), strict=True):
            terms[k] = found
        fault = [MANY if n > 1 else WRITTEN if a else NO_SUM if t is None else None for n, a, t in zip(known["n"][which].tolist(), again[which].tolist(), terms, strict=True)]
        slot, usable = np.full(len(token) + 1, -1), np.full(self.none + 1, -1)
        clear = [k for k, f in enumerate(fault) if f is None]
        slot[which[clear]] = clear
        usable[used] = slot[variable]
        value: list[str | None] = [None] * len(which)
        found = {"token": token[which], "fault": fault, "value": value, "usable": usable.tolist(), "codes": self.codes.tolist(), "said": self.said.tolist()}
        waits, asked = [0] * len(which), [[] for _ in which]  # how many names a variable waits for, and which variables wait for it
        ready: deque[int] = deque()
        for k in clear:
            names = {found["usable"][t] for t in terms[k] if found["said"][found["codes"][t]] is None}
            if -1 not in names:
                waits[k] = len(names)
                for v in names:
                    asked[v].append(k)
                if not names:
                    ready.append(k)
        while ready:
            k = ready.popleft()
            value[k] = added_up(found, terms[k])
            if value[k] is not None:
                for v in asked[k]:
                    waits[v] -= 1
                    if not waits[v]:
                        ready.append(v)
        return found

    def calls(self, methods: tuple[str, ...]) -> dict[str, np.ndarray]:
        """``open, method, root, link, plain`` of the calls ``receiver.method(...)`` of these methods, as ``calls.method_calls`` tells them."""
        n, order = self.none, self.order
        call = self.among(self.all, "(") & self.on
        chain = self.last(~self.on)
        b1, b2 = self.lag(1), self.lag(2)
        asked = np.array([self.code(m) for m in methods if self.code(m) >= 0], np.int64)
        t = np.flatnonzero(call & self.among(b2, ".") & (self.kind[b1] == NAMES) & np.isin(self.codes[b1], asked))

        def since(marks: np.ndarray) -> np.ndarray:
            """How many are marked from the chain's first token on."""
            summed = np.append(np.append(0, np.cumsum(marks[order])), 0)
            head = self.at[chain[t]]
            return summed[self.at[t] + 1] - summed[np.minimum(head, n)]

        link = since(call)
        plain = (chain[t] < n) & (self.kind[chain[t]] == NAMES) & (since(self.among(self.all, ".")) == link) & (since(self.among(self.all, "[")) == 0)
        return {"open": t, "method": b1[t], "root": chain[t], "link": link, "plain": plain}


def added_up(known: dict, terms: list[int]) -> str | None:
    """The strings of the terms, one after the other; None if one is not known, or they are too long. ``known``: the ``variables``."""
    texts = []
    for t in terms:
        text = known["said"][known["codes"][t]]
        if text is None and (k := known["usable"][t]) >= 0:
            text = known["value"][k]
        if text is None:
            return None
        texts.append(text)
    return "".join(texts) if sum(map(len, texts)) <= LONGEST else None


def read(found: pa.RecordBatch) -> Files:
    """The files of a batch of ``lists_of`` or of ``lists_of_rows``."""
    if "content" in found.schema.names:
        counts, start, line, kind, codes, words, of, place = numbered(found_in(found.column("content").to_pylist()), False)
        _, partner, parent = stacks(codes, words, of, place)
        return Files(counts, start, line, kind, codes, words, partner, parent)
    lists = found.column("found")
    flat = lists.flatten()
    number = lambda name: flat.field(name).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
    text = flat.field("text").dictionary_encode()
    kind = np.array([*map(KINDS.index, flat.field("kind").to_pylist())], np.int64)
    counts, codes = (x.to_numpy(zero_copy_only=False).astype(np.int64) for x in (lists.value_lengths(), text.indices))
    return Files(counts, number("start"), number("line"), kind, codes, text.dictionary.to_pylist(), number("partner"), number("parent"))


def parts_at_once(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch in stretches of about ``AT_ONCE`` tokens, or of twice as many characters."""
    sizes, most = (pc.binary_length(batch.column("content")), 2 * AT_ONCE) if "content" in batch.schema.names else (batch.column("found").value_lengths(), AT_ONCE)
    ends, at = np.cumsum(sizes.to_numpy(zero_copy_only=False).astype(np.int64)), 0
    while at < batch.num_rows:
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
        yield batch.slice(at, stop - at)
        at = stop


def lists_of(corpus: DataFrame) -> DataFrame:
    """``file, path, content``: each file of a corpus once, to be cut where its tokens are read."""
    return files_of(corpus, parts_of(corpus))


def lists_of_rows(rows: DataFrame) -> DataFrame:
    """The same of tokens of ``tokens.bracketed``."""
    token = F.struct("place", "start", "line", "kind", "text", "partner", "parent")
    return rows.groupBy("file", "path").agg(F.array_sort(F.collect_list(token)).alias("found"))


def told(lists: DataFrame, tell: Callable[[Files], tuple[np.ndarray, dict[str, pa.Array | np.ndarray | list]]], schema: str) -> DataFrame:
    """``file, path`` and the columns of ``schema``: what ``tell`` says of the files, by the number of the file that each row is of."""
    names = [c.split()[0] for c in schema.split(", ")]

    def walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts_at_once(batch):
                of, columns = tell(read(part))
                if len(of):
                    rows = pa.array(of, pa.int64())
                    yield pa.RecordBatch.from_arrays([part.column("file").take(rows), part.column("path").take(rows), *[arrow(columns[c]) for c in names]], names=["file", "path", *names])

    return lists.mapInArrow(walked, f"file binary, path string, {schema}")


def arrow(column) -> pa.Array:
    return column if isinstance(column, pa.Array) else pa.array(column)


def ints(values: np.ndarray, null: np.ndarray | None = None) -> pa.Array:
    return pa.array(values.astype(np.int32), pa.int32(), mask=null)


def words(files: Files, tokens: np.ndarray) -> pa.Array:
    """The tokens' texts, null for none."""
    return pa.array(files.words, pa.string()).take(pa.array(files.codes[tokens], mask=tokens == files.none))


def places(files: Files, tokens: np.ndarray) -> pa.Array:
    return ints(files.place(tokens), tokens == files.none)


def strings(values: list[str | None]) -> pa.Array:
    return pa.array(values, pa.string())
