"""Toxicity (operator 6): a weighted finite-state pattern grammar over clauses.

A lexical transducer turns a clause's words into classes: insult, weak insult, threat, target, negation, reporting verb,
other. A negation transducer rewrites an insult or threat that follows a negation within REACH words, a reported-speech
transducer one that follows a reporting verb, and a target transducer reads to the clause's end and gives the kind of
the clause. The three are composed into one table. A matched clause counts with the precision of its kind times that
of its word, a text with the noisy-or of its clauses. A clause with an insult and no target is a kind of its own, with a
precision of its own; a word outside a matched clause (a threat without a target, a target alone) counts nothing.

A weak insult is a beginning of words that clean texts have by chance, once in a while. So its arcs, and those of other
words, carry the log of how much likelier they are in a toxic text than in a clean one; a clause of the kind weak weighs
the sum of its arcs, any other clause that of its words as others, and the sum over clauses gives the posterior (of texts
with one such clause at least).

Insults are learned from labelled rows, beside a short list to start with: words and beginnings of words that stand in
toxic texts and hardly ever in others, chosen by sequential covering, so that a text already explained supports no
further one. Precisions are counted on the same rows, smoothed by priors. Training takes about SAMPLE labelled rows,
chosen by a hash of the id (a bounded sample); scoring covers every row and whole texts.

Null text: scored as an empty one, by the share of toxic texts among those without a match. Labels that are null are
left out; of several labels of a row the highest counts. With no labelled rows the priors hold alone."""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Callable, Iterable, Iterator
from math import exp, log, log1p

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .batches import kept_rows, per_text
from .common import stored, thinned

SAMPLE, THRESHOLD = 20_000, 0.7
REACH = 3
#: A learned insult stands in so many toxic training texts that no other one explains, with at most so many clean per toxic.
LEAST_NEW, MOST_CLEAN = 3, 0.02
#: The same for beginnings that stand in a text twice or more: these become weak insults.
MOST_CLEAN_TWICE = 0.3
BEGINNINGS = range(4, 10)

INSULTS = "idiot moron loser scum stupid pathetic worthless disgusting imbecile dumbass asshole bastard".split()
THREATS = "kill hurt beat destroy murder shoot stab töte töten umbringen tuer frapper matar golpear".split()
TARGETS = "you your yours yourself u ur du dich dir dein deine ihr euch tu toi te vous votre tú ti usted ustedes vosotros he she they him her them".split()
NEGATIONS = "not no never isn't aren't don't wasn't nicht kein keine nie niemals pas jamais nunca jamás".split()
REPORTS = "said says called wrote quoted claims alleged sagte schrieb nannte dit disait écrit dijo llamó escribió".split()

O, I, W, H, T, N, R = "other", "insult", "weak", "threat", "target", "negation", "report"
CLASSES = (O, I, W, H, T, N, R)
#: (toxic, clean) pseudo-counts of each kind of clause.
PRIORS = {"insult": (8, 2), "targeted insult": (9, 1), "targeted threat": (8, 2), "negated": (1, 3), "reported": (1, 3), "weak": (1, 9)}
#: (weak words, all words) that count beside those seen in toxic and in clean texts.
WEAK_PRIORS = ((1.0, 100.0), (0.2, 100.0))

_CLAUSE = re.compile(r"[^.!?;:,\n]+")
_WORD = re.compile(r"[^\W_]+(?:'[^\W_]+)*")


class Transducer:
    """step(state, symbol) -> (state, symbol); states are any values. final(state) is what a whole clause gives."""

    def __init__(self, start, step: Callable, final: Callable = lambda state: None):
        self.start, self.step, self.final = start, step, final


def negation() -> Transducer:
    """The state is how many further words a negation reaches."""

    def step(left: int, symbol: str):
        if symbol == N:
            return REACH, O
        return max(0, left - 1), f"negated {symbol}" if left and symbol in (I, W, H) else symbol

    return Transducer(0, step)


def reported_speech() -> Transducer:
    """The state is whether a reporting verb has been met."""

    def step(met: bool, symbol: str):
        return met or symbol == R, f"reported {symbol}" if met and symbol in (I, W, H) else O if symbol == R else symbol

    return Transducer(False, step)


def target() -> Transducer:
    """The state is what has been met, as a set; a clause's kind is the strongest that it allows."""
    met_by = {T: "T", I: "I", W: "w", H: "H", f"negated {I}": "n", f"negated {H}": "", f"reported {I}": "r", f"reported {H}": ""}

    def final(met: frozenset):
        if "H" in met and "T" in met:
            return "targeted threat"
        if "I" in met:
            return "targeted insult" if "T" in met else "insult"
        return "weak" if "w" in met else "reported" if "r" in met else "negated" if "n" in met else None

    return Transducer(frozenset(), lambda met, symbol: (met | set(met_by.get(symbol, "")), symbol), final)


def composed(parts: list[Transducer], symbols: Iterable[str]) -> tuple[list[dict[str, int]], list[str | None]]:
    """One table of what the parts do one after another: next states by symbol, and the last part's final values."""
    start = tuple(p.start for p in parts)
    number, table, todo = {start: 0}, [{}], [start]
    finals = [parts[-1].final(start[-1])]
    while todo:
        states = todo.pop()
        for symbol in symbols:
            out, now = [], symbol
            for part, state in zip(parts, states, strict=True):
                state, now = part.step(state, now)
                out.append(state)
            to = tuple(out)
            if to not in number:
                number[to] = len(table)
                table.append({})
                finals.append(parts[-1].final(to[-1]))
                todo.append(to)
            table[number[states]][symbol] = number[to]
    return table, finals


class Grammar:
    """words: insults and their precisions; a key with a * at its end is the beginning of a word, one with ** a weak one.

    weak_rates: the share of weak words in toxic and in clean texts with a weak clause, and the odds of being toxic of these."""

    def __init__(self, words: dict[str, float], kinds: dict[str, float], base: float, weak_rates: tuple[float, float, float] = (0.01, 0.002, 1 / 9)):
        self.weak_rates = weak_rates
        self.weak = tuple(k[:-2] for k in words if k.endswith("**"))
        words = {k: p for k, p in words.items() if not k.endswith("**")}
        self.words, self.kinds, self.base = words, kinds, base
        self.table, self.finals = composed([negation(), reported_speech(), target()], CLASSES)
        self.classes = {w: c for c, some in ((R, REPORTS), (N, NEGATIONS), (T, TARGETS), (H, THREATS)) for w in some}
        self.starts = {k[:-1]: p for k, p in words.items() if k.endswith("*")}
        self.lengths = sorted({len(k) for k in self.starts})
        seeds = [*map(re.escape, self.weak)] + [re.escape(k[:-1]) for k in words if k.endswith("*")] + [re.escape(k) + r"(?![^\W_])" for k in [*(k for k in words if not k.endswith("*")), *THREATS]]
        self.seed = re.compile(r"(?<![^\W_])(?:" + "|".join(seeds) + ")")

    def insult(self, word: str) -> float:
        """The precision of a word as an insult, 0 if it is none."""
        return max([self.words.get(word, 0.0), *(self.starts.get(word[:n], 0.0) for n in self.lengths)])

    def clauses(self, text: str) -> Iterator[tuple[str, float]]:
        """(kind, weight) of each clause that the grammar matches: the precision of its strongest insult, or for a weak
        one how many weak words it has."""
        lower = text.lower()
        seed = self.seed.search(lower)
        end = 0
        while seed:
            start = max(end, *(lower.rfind(c, end, seed.start()) + 1 for c in ".!?;:,\n"))
            clause = _CLAUSE.match(lower, start)
            state, weight, weak = 0, 0.0, 0
            for word in _WORD.findall(clause[0]):
                p = self.insult(word)
                weight = max(weight, p)
                is_weak = not p and word.startswith(self.weak)
                weak += is_weak
                state = self.table[state][I if p else W if is_weak else self.classes.get(word, O)]
            if kind := self.finals[state]:
                yield kind, weak if kind == "weak" else weight or 1.0
            end = clause.end()
            seed = self.seed.search(lower, end)

    def matches(self, text: str) -> tuple[set[tuple[str, float]], int, int]:
        """What a text has: (kind, precision) of its clauses that aren't weak, how many weak words its weak clauses have,
        and how many words there are in all."""
        found, weak = set(), 0
        for kind, weight in self.clauses(text):
            if kind == "weak":
                weak += int(weight)
            else:
                found.add((kind, weight))
        return found, weak, len(_WORD.findall(text)) if weak else 0

    def weak_posterior(self, weak: int, words: int) -> float:
        """How likely a text with so many weak words in weak clauses (one at least) is toxic."""
        toxic, clean, odds = self.weak_rates
        some = log1p(-((1 - toxic) ** words)) - log1p(-((1 - clean) ** words))  # that there is one is known
        sum_ = log(odds) + weak * log(toxic / clean) + (words - weak) * (log1p(-toxic) - log1p(-clean)) - some
        return 1 / (1 + exp(-max(-700.0, min(700.0, sum_))))

    def score(self, text: str | None) -> float:
        found, weak, words = self.matches(text or "")
        if not found and not weak:
            return self.base
        clean = 1 - self.weak_posterior(weak, words) if weak else 1.0
        for kind, weight in sorted(found):
            clean *= 1 - self.kinds[kind] * weight
        return 1 - clean


def _features(text: str) -> set[str]:
    """Words, beginnings with *, and beginnings that stand there twice or more with **."""
    words = Counter(_WORD.findall(text.lower()))
    begun = Counter()
    for w, n in words.items():
        for length in BEGINNINGS:
            if len(w) >= length:
                begun[w[:length]] += n
    return {*words, *(f"{b}*" for b in begun), *(f"{b}**" for b, n in begun.items() if n > 1)}


def prior_grammar() -> Grammar:
    return Grammar({w: 0.8 for w in INSULTS}, {k: a / (a + b) for k, (a, b) in PRIORS.items()}, 0.02)


def fit(docs: DataFrame, labels: DataFrame, trained: Column | None = None, key: str = "doc_id", text: str = "text", label: str = "toxic") -> Grammar:
    """The grammar learned from the rows of docs that have a label; trained: a condition on key."""
    known = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull())
    known = (known if trained is None else known.where(trained)).groupBy(F.col(key).alias("k")).agg(F.max(F.col(label).cast("int")).alias("y"))
    some = thinned(known, F.col("k"), known.count(), SAMPLE)
    # about SAMPLE rows of an id and a number: a bounded broadcast
    rows = stored(docs.select(F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t")).join(F.broadcast(some), "k").select("k", "y", "t"), "toxic-sample")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: dict[str, list[int]] = defaultdict(lambda: [0, 0, 0])

        def out():
            return pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), *(pa.array([v[i] for v in n.values()], pa.int64()) for i in (0, 1, 2))], names=["f", "clean", "toxic", "where"])

        for b in batches:
            for y, t, h in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                for f in _features(t):
                    v = n[f]
                    v[y > 0] += 1
                    if y > 0:
                        v[2] ^= h
                if len(n) > 400_000:
                    yield out()
                    n.clear()
        yield out()

    counts = rows.select("y", "t", F.xxhash64("k", "t").alias("h")).mapInArrow(counted, "f string, clean bigint, toxic bigint, where bigint").groupBy("f").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"), F.bit_xor("where").alias("where"))
    counts = counts.where((F.col("toxic") >= LEAST_NEW) & (F.col("clean") <= F.when(F.col("f").endswith("**"), MOST_CLEAN_TWICE).otherwise(MOST_CLEAN) * F.col("toxic")))
    # features of the same toxic texts and as many clean ones gain the same: the one that cover prefers stands for all.
    # What is left is bounded by the sample.
    liked = F.struct((F.col("f").endswith("*") & ~F.col("f").endswith("**")).alias("whole"), F.col("f").endswith("**").alias("weak"), F.length("f").alias("n"), "f")
    kept = counts.groupBy("toxic", "clean", "where").agg(F.max(liked).alias("best")).select("best.f", "toxic", "clean")
    candidates = {r["f"]: (r["toxic"], r["clean"]) for r in kept.collect()}

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([sorted(f for f in _features(t) if f in candidates) for t in b.column(1).to_pylist()], pa.list_(pa.string()))], names=["k", "fs"])

    kind = docs.schema[key].dataType.simpleString()
    toxic = [set(r["fs"]) for r in rows.where("y > 0").select("k", "t").mapInArrow(held, f"k {kind}, fs array<string>").orderBy("k").collect()]  # of the bounded sample
    words = {w: 0.8 for w in INSULTS}
    words |= {f: (candidates[f][0] + 4) / (sum(candidates[f]) + 5) for f in cover(toxic, candidates, set(INSULTS))}
    words = {w: p for w, p in words.items() if w not in candidates or (candidates[w][0] + 4) / (sum(candidates[w]) + 5) >= 0.5}

    first = Grammar(words, dict.fromkeys(PRIORS, 0.5), 0.0)

    def kinds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: dict[str, list[int]] = defaultdict(lambda: [0, 0])
        for b in batches:
            for y, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                found, weak, words = first.matches(t)
                for k in {k for k, _ in found}:
                    n[k][y > 0] += 1
                if not found:  # texts that only weak clauses speak against, and those without any match
                    for k, x in (("weak", 1), ("weak words", weak), ("words", words)) if weak else (("", 1),):
                        n[k][y > 0] += x
        yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), *(pa.array([v[i] for v in n.values()], pa.int64()) for i in (0, 1))], names=["k", "clean", "toxic"])

    seen = {r[0]: (r[2], r[1]) for r in rows.select("y", "t").mapInArrow(kinds, "k string, clean bigint, toxic bigint").groupBy("k").agg(F.sum("clean"), F.sum("toxic")).collect()}
    weights = {}
    for k, (a, b) in PRIORS.items():
        toxic_n, clean_n = seen.get(k, (0, 0))
        weights[k] = (toxic_n + a) / (toxic_n + clean_n + a + b)
    rates = [weak_rate(*(seen.get(k, (0, 0))[i] for k in ("weak words", "words", "weak")), *prior) for i, prior in enumerate(WEAK_PRIORS)]
    none = seen.get("", (0, 0))
    return Grammar(words, weights, min(0.5, (none[0] + 1) / (sum(none) + 50)), (rates[0], rates[1], weights["weak"] / (1 - weights["weak"])))


def weak_rate(weak: int, words: int, texts: int, more_weak: float, more_words: float) -> float:
    """The share of weak words, from texts that have one at least: the mean number of these is that of a binomial
    without its zero."""
    share, length = (weak + more_weak) / (words + more_words), (words + more_words) / (texts + 1)
    rate = share
    for _ in range(100):
        rate = share * (1 - (1 - rate) ** length)
    return max(rate, share / 10)  # where texts have one each, nothing speaks for any rate over 0


def cover(toxic: list[set[str]], candidates: dict[str, tuple[int, int]], given: set[str]) -> list[str]:
    """Candidates that explain the toxic texts one after another: each time the one in most texts not yet explained,
    less the clean ones; of equal ones a whole beginning before a weak one and before a word, then the longest."""
    left = [fs for fs in toxic if not fs & given]
    chosen = []
    while True:
        n: dict[str, int] = defaultdict(int)
        for fs in left:
            for f in fs:
                n[f] += 1
        gain = lambda f: n[f] - candidates[f][1]
        best = max(n, key=lambda f: (gain(f), f.endswith("*") and not f.endswith("**"), f.endswith("**"), len(f), f), default=None)
        if best is None or gain(best) < LEAST_NEW:
            return chosen
        chosen.append(best)
        left = [fs for fs in left if best not in fs]


def score(docs: DataFrame, grammar: Grammar, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, score (0 to 1) and predicted (1 from THRESHOLD on) of each row."""

    def make():
        return lambda texts: ([grammar.score(t) for t in texts],)

    return per_text(docs, make, "score double", key, text).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def clean_rows(docs: DataFrame, grammar: Grammar, text: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, that score under THRESHOLD."""
    return kept_rows(docs, lambda: lambda texts: (grammar.score(t) < THRESHOLD for t in texts), text)
