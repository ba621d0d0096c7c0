"""Toxicity by a weighted finite-state pattern grammar.

A text is cut in clauses and each clause is read as a sequence of word classes. Five small weighted transducers stand in a cascade, each reading what the
one before writes: insult and threat turn words into events, target marks an event with a second-person word near it on either side,
negation an event in the scope of a negator, reported speech an event inside a quotation or after a verb of saying. They are composed into one
deterministic machine whose transitions carry the summed weights; a clause's weight is that of its path and of the end. Only a clause
above 0 is matched, and a text's score comes from its matched clauses alone: words that match no clause add nothing.

The weights start from the grammar's own, with which a clause needs an event that is aimed at someone, and are fitted on labelled rows (negation and reported
speech can only lower a clause). The insult class is a fixed seed list plus words and word beginnings induced from labelled rows: in many toxic rows, in
different contexts (near copies of one row are one piece of evidence), and in no clean one.

Cases: null and empty texts have no clause and get the base score; a text is read whole, in pieces cut at ends of clauses if it is above PIECE bytes (a longer
clause is cut at a blank); case is folded in Unicode; a clause ends at . ! ? ; or a line break; repeated rows score equally; bytes that are no UTF-8 count as
U+FFFD; empty tables give no rows; without labels the seed grammar alone scores; extra columns pass by.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame

from .common import LOWER, _LUT, buffers, cut_rows, release, spans_hash, steps, with_text

#: Labelled rows of each class that the grammar is fitted on, at most about.
FIT_ROWS = 3000
PIECE = 1 << 20

# The grammar's closed word classes.
SEED_INSULTS = "idiot moron loser scum trash pathetic worthless disgusting stupid clown".split()
THREATS = "kill hurt destroy beat burn stab shoot strangle töten umbringen tuer frapper matar golpear".split()
TARGETS = "you your yours yourself du dich dir dein deine ihr euch tu te toi vous votre tú ti usted ustedes vosotros".split()
NEGATORS = "not no never isn't aren't don't nicht kein keine nie pas jamais ne aucun nunca jamás ni".split()
REPORTERS = "said says say claimed wrote reported quoted sagte sagt schrieb dit écrit affirmé dijo dice escribió".split()
SELF = "i we i'll we'll ich wir je nous yo nosotros".split()

#: Words after a negator, a verb of saying or a first person, and around a target, that an event is still in the scope of.
SCOPE = 4
FREE, INSULT, THREAT, TARGET, NEGATOR, REPORTER, QUOTE, FIRST = range(8)
#: What the first two transducers write for a word that is an event.
EVENT = 8
#: The transitions' weights before any label is seen; `end` is the weight of a clause's end, `base` a text's without a matched clause.
PRIOR = {"insult": 0.15, "threat": 0.1, "by_first": 1.0, "aimed": 2.0, "negated": -2.2, "reported": -2.2, "end": -1.0, "base": -2.5}
ARCS = ("insult", "threat", "by_first", "aimed", "negated", "reported")
#: A matched clause's effect on a text: GAIN * log(1 + summed weights of matched clauses).
GAIN = 4.0


class Transducer:
    """Deterministic weighted transducer: (state, symbol) -> (state, symbol, arcs). The weight of a transition is the sum of the weights named by arcs, a number of
    20 binary digits for each of ARCS."""

    def __init__(self, start, step):
        self.start, self.step = start, step

    def compose(self, after: "Transducer") -> "Transducer":
        """What this one writes, the other reads; weights add up. The product's states are made when first met and kept."""
        cache: dict = {}

        def step(state, symbol):
            got = cache.get((state, symbol))
            if got is None:
                a, mid, x = self.step(state[0], symbol)
                b, out, y = after.step(state[1], mid)
                got = cache[state, symbol] = ((a, b), out, x + y)
            return got

        return Transducer((self.start, after.start), step)


def _arc(name: str, times: int = 1) -> int:
    return times << 20 * ARCS.index(name)


def _insult() -> Transducer:
    return Transducer(0, lambda s, x: (s, EVENT, _arc("insult")) if x == INSULT else (s, x, 0))


def _threat() -> Transducer:
    """A state is the words left in which a first person still makes a threat."""
    def step(left, x):
        after = SCOPE if x == FIRST else max(0, left - 1)
        return (after, EVENT, _arc("threat") + _arc("by_first", int(left > 0))) if x == THREAT else (after, x, 0)

    return Transducer(0, step)


def _target() -> Transducer:
    """A state is the words left after a target, and which of the last SCOPE words are events that no target has been met for."""
    def step(state, x):
        left, waiting = state
        if x == TARGET:
            return (SCOPE, 0), x, _arc("aimed", waiting.bit_count())
        waiting = waiting << 1 & (1 << SCOPE) - 1
        if x == EVENT and not left:
            waiting |= 1
        return (max(0, left - 1), waiting), x, _arc("aimed") if x == EVENT and left else 0

    return Transducer((0, 0), step)


def _scope(opener: int, name: str) -> Transducer:
    """Weighs the events up to SCOPE words after an opener."""
    return Transducer(0, lambda left, x: (SCOPE, x, 0) if x == opener else (max(0, left - 1), x, _arc(name) if x == EVENT and left else 0))


def _reported() -> Transducer:
    """A state is the words left after a verb of saying, and whether a quotation is open."""
    def step(state, x):
        left, inside = state
        after = SCOPE if x == REPORTER else max(0, left - 1)
        return (after, inside != (x == QUOTE)), x, _arc("reported") if x == EVENT and (left or inside) else 0

    return Transducer((0, False), step)


GRAMMAR = _insult().compose(_threat()).compose(_target()).compose(_scope(NEGATOR, "negated")).compose(_reported())


def path(kinds: list[int]) -> list[int]:
    """How often a clause's path takes each of ARCS."""
    state, total = GRAMMAR.start, 0
    for kind in kinds:
        state, _, arcs = GRAMMAR.step(state, kind)
        total += arcs
    return [total >> 20 * i & (1 << 20) - 1 for i in range(len(ARCS))]


def text_score(clauses: np.ndarray, w: np.ndarray) -> float:
    """Log-odds of a text from its clauses' paths; w: weights of ARCS, of the end, of the base."""
    weight = clauses @ w[: len(ARCS)] + w[-2] if len(clauses) else np.zeros(0)
    return float(w[-1] + GAIN * np.log1p(weight[weight > 0].sum()))


_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".!?;\n\r"]] = True
_GAP = np.zeros(256, bool)
_GAP[32] = True
_WORD = np.zeros(256, bool)
_WORD[128:] = True
_WORD[[ord(c) for c in "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789'"]] = True


def _tokens(buf: np.ndarray, off: np.ndarray):
    """Words (runs of letters, digits and apostrophes) and double quotes: start, end, row, clause number."""
    n = len(buf)
    word, inner = _WORD[buf], off[(off > 0) & (off < n)]
    before, after = np.ones(n, bool), np.ones(n, bool)
    before[1:] = ~word[:-1]
    before[inner] = True
    after[:-1] = ~word[1:]
    after[inner - 1] = True
    quote = buf == 34
    start, end = np.flatnonzero((before & word) | quote), np.flatnonzero((after & word) | quote) + 1
    brk = _STOP[buf].astype(np.int64)
    brk[inner] += 1
    return start, end, np.searchsorted(off, start, side="right") - 1, np.cumsum(brk)[start]


def _word_hash(word: str) -> int:
    raw = np.frombuffer(word.encode(), np.uint8)
    return int(spans_hash(_LUT[LOWER[raw]], np.array([0]), np.array([len(raw)]))[0])


class Lexicon:
    """Word and word-beginning hashes with their classes; small, whatever the input."""

    def __init__(self, insults: list[str], beginnings: list[str]):
        kinds = {_word_hash(w): k for k, ws in ((INSULT, [*SEED_INSULTS, *insults]), (THREAT, THREATS), (TARGET, TARGETS), (NEGATOR, NEGATORS), (REPORTER, REPORTERS), (FIRST, SELF), (QUOTE, ['"'])) for w in ws}
        self.hashes = np.array(sorted(kinds), np.uint64)
        self.kinds = np.array([kinds[h] for h in sorted(kinds)], np.int8)
        self.beginnings = {n: np.array(sorted(_word_hash(b) for b in beginnings if len(b.encode()) == n), np.uint64) for n in {len(b.encode()) for b in beginnings}}

    @staticmethod
    def _find(table: np.ndarray, h: np.ndarray) -> np.ndarray:
        """Index in table of each hash, or -1. A 64 Ki-bit map drops nearly all others first."""
        seen = np.zeros(1 << 16, bool)
        seen[(table & np.uint64(0xFFFF)).astype(np.int64)] = True
        out = np.full(len(h), -1)
        maybe = np.flatnonzero(seen[(h & np.uint64(0xFFFF)).astype(np.int64)])
        at = np.minimum(np.searchsorted(table, h[maybe]), max(0, len(table) - 1))
        out[maybe] = np.where(table[at] == h[maybe], at, -1)
        return out

    def classes(self, values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        at = self._find(self.hashes, spans_hash(values, start, end))
        kinds = np.where(at >= 0, self.kinds[at], FREE)
        for n, table in self.beginnings.items():
            long = np.flatnonzero((end - start > n) & (kinds == FREE))
            kinds[long[self._find(table, spans_hash(values, start[long], start[long] + n)) >= 0]] = INSULT
        return kinds

    def paths(self, buf: np.ndarray, off: np.ndarray) -> dict[int, np.ndarray]:
        """Paths of the clauses of rows (lower-case) that have an event. Only clauses with an insult or threat word are run through the machine."""
        out: dict[int, list] = defaultdict(list)
        cut, owner = cut_rows(buf, off, PIECE, _STOP, _GAP)
        for a, b in steps(cut):
            self._paths(buf[cut[a] : cut[b]], cut[a : b + 1] - cut[a], owner[a:b], out)
        return {i: np.array(x, np.float64) for i, x in out.items()}

    def _paths(self, buf, off, owner, out) -> None:
        if not len(buf):
            return
        start, end, row, clause = _tokens(buf, off)
        if not len(start):
            return
        kinds = self.classes(_LUT[LOWER[buf]], start, end)
        hot = np.flatnonzero((kinds == INSULT) | (kinds == THREAT))
        done = -1
        for i in hot:
            if i <= done:
                continue
            lo, hi = int(np.searchsorted(clause, clause[i])), int(np.searchsorted(clause, clause[i], side="right"))
            done = hi - 1
            out[int(owner[row[i]])].append(path(kinds[lo:hi].tolist()))


def folded_text(column: pa.Array) -> pa.Array:
    """Texts in lower case, by Unicode."""
    try:
        return pc.utf8_lower(column)
    except pa.ArrowInvalid:  # some bytes are no UTF-8
        return pa.array([None if x is None else x.decode("utf-8", "replace").lower() for x in column.cast(pa.binary()).to_pylist()], pa.string())


def _words_of(text: str) -> list[str]:
    raw = np.frombuffer(text.encode(), np.uint8)
    if not len(raw):
        return []
    start, end, _, _ = _tokens(raw, np.array([0, len(raw)]))
    low = LOWER[raw].tobytes()
    return [low[a:b].decode(errors="replace") for a, b in zip(start.tolist(), end.tolist())]


def induce(texts: list[str], y: np.ndarray) -> tuple[list[str], list[str]]:
    """Insult words and word beginnings that only toxic rows have, as far as chance goes: the log-likelihood ratio of a
    word's rows against the classes' shares must stand out among all words tested (Bonferroni at 1 %). Evidence is the number
    of different words before it, so copies of one row count once. A beginning (4 to 7 letters) needs 3 different words."""
    good: dict = defaultdict(int)
    bad: dict = defaultdict(int)
    after: dict = defaultdict(set)
    for text, toxic in zip(texts, y):
        own = _words_of(text)
        count = bad if toxic else good
        for w in set(own):
            count[w] += 1
    n_bad, n_good = max(1, int(y.sum())), max(1, int((1 - y).sum()))
    # contexts are counted in full, but only of words that clean rows have seldom enough
    rare = {w for w, n in bad.items() if len(w) > 2 and good.get(w, 0) / n_good <= 0.02 * n / n_bad}
    for text in (t for t, toxic in zip(texts, y) if toxic):
        own = _words_of(text)
        for a, w in zip(["", *own], own):
            if w in rare:
                after[w].add(a)
    share = n_bad / (n_bad + n_good)

    def ratio(a: float, b: float) -> float:
        """2 ln(likelihood with the word's own share of toxic rows / likelihood with the classes' share)."""
        n, p = a + b, a / (a + b)
        return 0.0 if p <= share else 2 * (a * np.log(p / share) + (b * np.log((1 - p) / (1 - share)) if b else 0))

    def bound(tests: int) -> float:
        return 2 * (np.log(max(tests, 1)) + np.log(100))

    least = bound(len(bad))
    words = sorted(w for w in rare if ratio(min(bad[w], len(after[w])), good.get(w, 0)) >= least)
    clean, begins = set(), defaultdict(lambda: [set(), 0, set()])
    for w in good:
        clean.update(w[:n] for n in range(4, 8))
    for w, n in bad.items():
        for k in range(4, min(7, len(w) - 1) + 1):
            if w[:k] not in clean:
                b = begins[w[:k]]
                b[0].add(w)
                b[1] += n
                b[2] |= after[w]
    many = {b: x for b, x in begins.items() if len(x[0]) >= 3}
    least = bound(len(many))
    ok = {b for b, (_, n, ctx) in many.items() if ratio(min(n, len(ctx)), 0) >= least}
    return words, sorted(b for b in ok if not any(b[:k] in ok for k in range(4, len(b))))


def _fit_weights(rows: np.ndarray, x: np.ndarray, y: np.ndarray, rounds: int = 600) -> np.ndarray:
    """Weights for clauses x (paths; rows: each one's text) and labels y of texts, drawn to PRIOR where labels say little: Adam on the logistic loss, weights kept on
    their side of 0. While fitting, a clause that isn't matched passes a fifth of its gradient on, else it could never become one."""
    prior = np.array(list(PRIOR.values()))
    low = np.array([0, 0, 0, 0, -np.inf, -np.inf, -np.inf, -np.inf])
    high = np.array([np.inf] * 4 + [0, 0, 0, np.inf])
    k, n = len(ARCS), len(y)
    w, best = prior.copy(), (np.inf, prior)
    m, v = np.zeros_like(w), np.zeros_like(w)
    full = np.concatenate([x, np.ones((len(x), 1))], 1)
    for t in range(1, rounds + 1):
        weight = full @ w[: k + 1]
        total = np.bincount(rows, weights=np.maximum(weight, 0), minlength=n)
        z = w[-1] + GAIN * np.log1p(total)
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        loss = np.logaddexp(0, np.where(y == 1, -z, z)).sum() + 0.15 * ((w - prior) ** 2).sum()
        if loss < best[0]:
            best = loss, w.copy()
        d = p - y
        per = (d * GAIN / (1 + total))[rows] * np.where(weight > 0, 1, 0.2)
        g = np.concatenate([full.T @ per, [d.sum()]]) + 0.3 * (w - prior)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w = np.clip(w - 0.05 * (1 - t / rounds / 1.1) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9), low, high)
    return best[1]


def fit(texts: list[str], y: np.ndarray) -> tuple[Lexicon, np.ndarray]:
    """The lexicon, and the weights of ARCS, of the end and of the base."""
    column = folded_text(pa.array(texts, pa.string()))
    lexicon = Lexicon(*induce(column.to_pylist(), y)) if len(y) and y.any() else Lexicon([], [])
    buf, off = buffers(column)
    found = lexicon.paths(buf, off)
    rows = np.array([i for i in sorted(found) for _ in found[i]], np.int64)
    x = np.concatenate([found[i] for i in sorted(found)]) if found else np.zeros((0, len(ARCS)))
    return lexicon, _fit_weights(rows, x, y) if len(y) else np.array(list(PRIOR.values()))


def score(docs: DataFrame, model: tuple[Lexicon, np.ndarray], keep: list[Column]) -> DataFrame:
    """keep's columns with score and predicted (score >= 0.5); one narrow pass over whole texts."""
    lexicon, w = model
    given, at_text, kept = with_text(docs, keep)
    names = given.columns[:kept]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in given.schema[:kept]) + ", score double, predicted int"

    def run(batches):
        for batch in batches:
            buf, off = buffers(folded_text(batch.column(at_text)))
            z = np.full(batch.num_rows, w[-1])
            for i, clauses in lexicon.paths(buf, off).items():
                z[i] = text_score(clauses, w)
            p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:kept], pa.array(p), pa.array((p >= 0.5).astype(np.int32))], [*names, "score", "predicted"])
            release()

    return given.mapInArrow(run, schema)
