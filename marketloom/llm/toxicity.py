"""Toxicity by a weighted finite-state pattern grammar.

Every token is mapped to a symbol (insult, threat, target, negation, report, clause end, other). Three sequential
transducers read the symbols clause by clause and are composed into one table: the first marks insults and threats as
plain, negated or reported by what stands before them, the second marks insults that a target stands next to, the third
lets a threat count only with a target after it. What they write are events (insult-plain, aim-negated, ...); a text's
score is a logistic function of the events' sums, each with a weight of its own. Insult stems are induced from the
labelled training rows: words, and beginnings of words, that stand plain in many different surroundings in toxic texts
and, plain, in none of the others. The events' weights are fitted on the same rows, around prior weights that say what
each rule means where the rows have no case of it.
"""

from __future__ import annotations

import bisect
import math
import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table, tidy, unused

#: The closed classes of the grammar, in the corpus's languages.
THREATS = "kill hurt destroy beat burn smash stab shoot töten schlagen tuer frapper matar golpear".split()
TARGETS = "you your yours u he she they them these those people du dich dein ihr euch tu toi ton vous votre tú te usted ustedes".split()
NEGATIONS = "not no never isn't aren't don't won't nicht kein keine nie pas jamais ne nunca jamás".split()
REPORTS = "said says say told called calls wrote writes quoted reported sagte sagt schrieb dit disait écrit dijo dice escribió".split()
WORDS = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?|[.!?;:\n]")
CLAUSE_ENDS = frozenset(".!?;:\n")

#: Stems are induced from at most this many labelled training rows, those of the smallest hashes.
MAX_TRAIN_ROWS = 20_000
#: Shortest and longest beginning of a word that can be a stem.
STEM_CHARS = (4, 8)
#: Different surroundings that a stem needs in toxic texts, at least.
MIN_CONTEXTS = 4
#: Expected number of stems that chance alone would add.
CHANCE = 0.05
#: Stems that are tried, about.
TRIED = 1e6
#: Largest share of other texts to toxic texts that hold a stem.
MAX_CLEAN = 0.01
#: A longer stem replaces a shorter one if it covers this share of its toxic texts.
SAME_COVER = 0.97
#: Words that a negation reaches, and that a target reaches to either side.
NEGATED_WORDS, AIMED_WORDS = 5, 3

INSULT, THREAT, TARGET, NEGATION, REPORT, END, OTHER = SYMBOLS = range(7)
CLOSED = {w: k for k, ws in ((THREAT, THREATS), (TARGET, TARGETS), (NEGATION, NEGATIONS), (REPORT, REPORTS)) for w in ws} | dict.fromkeys(CLAUSE_ENDS, END)
MODES = ("plain", "negated", "reported")
EVENTS = tuple(f"{rule}-{mode}" for rule in ("insult", "aim", "threat") for mode in MODES)
#: Weights before any row is seen: of nothing at all, then of each event.
PRIOR = (-3.0, 5.0, 0.5, 1.0, 1.0, 0.3, 0.5, 5.0, 0.5, 1.0)
#: How firmly the weights are held there, in rows.
PRIOR_ROWS = 0.3

Arcs = dict[tuple, tuple]


class Transducer:
    """A sequential transducer: arcs from (state, read symbol) to (next state, written symbol)."""

    def __init__(self, start: tuple, arcs: Arcs):
        self.start, self.arcs = start, arcs

    @staticmethod
    def of(start: tuple, alphabet: Iterable, step: Callable) -> Transducer:
        """The states that can be reached from the start by a step of (state, symbol) to (next state, written symbol)."""
        alphabet, arcs, todo, seen = list(alphabet), {}, [start], {start}
        while todo:
            state = todo.pop()
            for symbol in alphabet:
                arcs[state, symbol] = step(state, symbol)
                if (then := arcs[state, symbol][0]) not in seen:
                    seen.add(then)
                    todo.append(then)
        return Transducer(start, arcs)

    def written(self) -> set:
        return {out for _, out in self.arcs.values()}

    def then(self, other: Transducer) -> Transducer:
        """The composition: what this one writes the other reads."""

        def step(state: tuple, symbol: object) -> tuple:
            mine, middle = self.arcs[state[0], symbol]
            its, out = other.arcs[state[1], middle]
            return (mine, its), out

        return Transducer.of((self.start, other.start), {symbol for _, symbol in self.arcs}, step)


def scope() -> Transducer:
    """Marks insults and threats by a negation up to NEGATED_WORDS before, or a verb of reported speech anywhere before, in their clause."""

    def step(state: tuple, symbol: int) -> tuple:
        left, reported = state
        mode = "negated" if left else "reported" if reported else "plain"
        on = (max(0, left - 1), reported)
        return {
            INSULT: (on, f"insult-{mode}"), THREAT: (on, f"threat-{mode}"), TARGET: (on, "target"), END: ((0, False), "end"),
            NEGATION: ((NEGATED_WORDS, reported), "other"), REPORT: ((on[0], True), "other"), OTHER: (on, "other"),
        }[symbol]

    return Transducer.of((0, False), SYMBOLS, step)


def aim(alphabet: set[str]) -> Transducer:
    """Adds aim to insults with a target up to AIMED_WORDS before, or to the target that follows one so near."""

    def step(state: tuple, symbol: str) -> tuple:
        what, left = state
        on = (what, left - 1) if left > 1 else ("", 0)
        if symbol == "end":
            return ("", 0), symbol
        if symbol.startswith("insult-"):
            mode = symbol.partition("-")[2]
            return (on, f"{symbol} aim-{mode}") if what == "target" else ((mode, AIMED_WORDS), symbol)
        if symbol == "target":
            return ("target", AIMED_WORDS + 1), f"target aim-{what}" if what in MODES else symbol
        return on, symbol

    return Transducer.of(("", 0), alphabet, step)


def threat(alphabet: set[str]) -> Transducer:
    """Lets a threat through when a target follows it up to AIMED_WORDS after; all else stays as it is."""

    def step(state: tuple, symbol: str) -> tuple:
        mode, left = state
        on = (mode, left - 1) if left > 1 else ("", 0)
        if symbol == "end":
            return ("", 0), ""
        if symbol.startswith("threat-"):
            return (symbol.partition("-")[2], AIMED_WORDS), ""
        events = " ".join(x for x in symbol.split() if "-" in x)
        if symbol.startswith("target") and mode:
            return ("", 0), f"{events} threat-{mode}".strip()
        return on, events

    return Transducer.of(("", 0), alphabet, step)


def composed() -> Transducer:
    first = scope()
    second = first.then(aim(first.written()))
    return second.then(threat(second.written()))


def table_of(t: Transducer) -> list[list[tuple[int, tuple[int, ...]]]]:
    """Per state and symbol the next state and the numbers of the events that are written."""
    names = {t.start: 0}
    for state, _ in t.arcs:
        names.setdefault(state, len(names))
    out = [[(0, ())] * len(SYMBOLS) for _ in names]
    for (state, symbol), (then, said) in t.arcs.items():
        out[names[state]][symbol] = names[then], tuple(EVENTS.index(e) for e in said.split())
    return out


class Grammar:
    """stems: weight of each induced stem; a stem that ends in * matches every word that begins so. weights: as PRIOR."""

    def __init__(self, stems: dict[str, float], weights: tuple[float, ...] = PRIOR):
        self.words = {s: w for s, w in stems.items() if s[-1] != "*"}
        self.starts = {s[:-1]: w for s, w in stems.items() if s[-1] == "*"}
        self.lengths = sorted({len(s) for s in self.starts})
        self.weights = weights
        self.table = table_of(composed())
        self.known: dict[str, float] = {}

    def insult(self, word: str) -> float:
        """Weight of a word as an insult; 0: none."""
        w = self.known.get(word)
        if w is None:
            w = self.words.get(word, 0.0)
            for n in self.lengths:
                if n <= len(word):
                    w = max(w, self.starts.get(word[:n], 0.0))
            if len(self.known) > 100_000:
                self.known.clear()
            self.known[word] = w
        return w

    def clauses(self, text: str) -> Iterator[list[str]]:
        """The tokens of each clause that holds an insult or a threat; no other clause writes an event."""
        tokens = WORDS.findall(text.lower())
        insult = self.insult
        hot = [i for i, t in enumerate(tokens) if insult(t) or CLOSED.get(t) == THREAT]
        if not hot:
            return
        ends = [i for i, t in enumerate(tokens) if t in CLAUSE_ENDS]
        seen = -1
        for i in hot:
            if i >= seen:
                k = bisect.bisect_left(ends, i)
                first, seen = ends[k - 1] + 1 if k else 0, ends[k] if k < len(ends) else len(tokens)
                yield tokens[first:seen]

    def events(self, text: str | None) -> list[float]:
        """The sum of each event over the text's clauses; insults, and aims at them, count by the stem's weight."""
        sums = [0.0] * len(EVENTS)
        for tokens in self.clauses(text or ""):
            state, last = 0, 0.0
            for t in tokens:
                w = self.insult(t)
                last = w or last
                state, said = self.table[state][INSULT if w else CLOSED.get(t, OTHER)]
                for e in said:
                    sums[e] += 1.0 if e >= 2 * len(MODES) else last
        return sums

    def features(self, text: str | None) -> list[float]:
        return [math.log1p(x) for x in self.events(text)]

    def score(self, text: str | None) -> float:
        z = self.weights[0] + sum(w * x for w, x in zip(self.weights[1:], self.features(text), strict=True))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def training_rows(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAIN_ROWS) -> DataFrame:
    """text, toxic of the labelled rows that training may see, one row for each different text and label."""
    kept = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0
    lab = labels.filter(F.col("toxic").isNotNull() & kept).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    lab = lab.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    rows = docs.filter(F.col("text").isNotNull()).select("doc_id", "text").join(F.broadcast(lab), "doc_id")
    return rows.groupBy(F.xxhash64("text").alias("h"), (F.col("toxic") > 0).cast("int").alias("toxic")).agg(F.first("text").alias("text")).select("text", "toxic")


def plain_words(text: str, arcs: Arcs) -> Iterator[tuple[str, str]]:
    """(word, what stands around it) of the words that would be plain insults, were they insults."""
    state, before, tokens = (0, False), "", WORDS.findall(text.lower())
    for i, t in enumerate(tokens):
        k = CLOSED.get(t, OTHER)
        if k != END:
            if arcs[state, INSULT][1] == "insult-plain":
                after = tokens[i + 1] if i + 1 < len(tokens) and tokens[i + 1] not in CLAUSE_ENDS else ""
                yield t, f"{before} {after}"
            before = t
        state = arcs[state, k][0]


def stems_of(word: str, chars: tuple[int, int]) -> Iterator[str]:
    """A word, and each beginning of it that may be a stem (with *)."""
    yield word
    for n in range(chars[0], min(chars[1], len(word)) + 1):
        yield word[:n] + "*"


def stem_counts(rows: DataFrame, need: int, chars: tuple[int, int] = STEM_CHARS) -> dict[str, tuple[int, int]]:
    """p, n of stems in ``need`` different surroundings or more: toxic texts and other texts that hold them plain."""

    def toxic(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arcs = scope().arcs
        for batch in batches:
            for text in batch.column(0).to_pylist():
                own = {s: hash_of(around) for w, around in plain_words(text, arcs) for s in stems_of(w, chars)}
                yield pa.RecordBatch.from_pydict({"stem": pa.array(own.keys(), pa.string()), "around": pa.array(own.values(), pa.int64())})

    found = rows.filter("toxic = 1").select("text").mapInArrow(tidy(toxic), "stem string, around long").groupBy("stem", "around").agg(F.count("*").alias("p"))
    found = found.groupBy("stem").agg(F.sum("p").alias("p"), F.count("*").alias("cp")).filter(F.col("cp") >= need)
    p = {r.stem: r.p for r in found.collect()}  # bounded by the training rows

    def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, int] = {}
        arcs = scope().arcs
        for batch in batches:
            for text in batch.column(0).to_pylist():
                for s in {x for w in {w for w, _ in plain_words(text, arcs)} for x in stems_of(w, chars)} & p.keys():
                    seen[s] = seen.get(s, 0) + 1
        yield pa.RecordBatch.from_pydict({"stem": pa.array(seen.keys(), pa.string()), "n": pa.array(seen.values(), pa.int64())})

    n = {r.stem: r.n for r in rows.filter("toxic = 0").select("text").mapInArrow(tidy(others), "stem string, n long").groupBy("stem").agg(F.sum("n").alias("n")).collect()}
    return {s: (x, n.get(s, 0)) for s, x in p.items()}


def hash_of(text: str) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")) - 2**63


def learn(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAIN_ROWS) -> Grammar:
    """Induces the stems and fits the weights. Without labels, or without toxic ones, no stem: all scores are low."""
    rows = training_rows(docs, labels, max_rows)
    counts = {r.t: r.c for r in rows.groupBy(F.signum("toxic").cast("int").alias("t")).agg(F.count("*").alias("c")).collect()}
    pos, neg = counts.get(1, 0), counts.get(0, 0)
    if not pos or not neg:
        return Grammar({})
    share = pos / (pos + neg)
    # A stem that only chance links to toxic texts has p of p + n rows with probability share^p at most.
    need = max(MIN_CONTEXTS, math.ceil(math.log(CHANCE / TRIED) / math.log(min(share, 0.99))))
    rows = cut(rows)
    found = stem_counts(rows, need)
    return fit(chosen({s: x for s, x in found.items() if x[1] <= MAX_CLEAN * x[0]}), rows)


def chosen(found: dict[str, tuple[int, int]]) -> dict[str, float]:
    """Of stems that begin with one another the longest that covers as much, then none that a shorter one implies; with weights in 0..1."""
    order = sorted(found, key=lambda s: (-len(s.rstrip("*")), s[-1] == "*"))
    covered: dict[str, int] = {}  # most that a longer stem covers
    kept: dict[str, tuple[int, int]] = {}
    for s in order:
        word, (p, n) = s.rstrip("*"), found[s]
        if s[-1] != "*" or covered.get(word, 0) < SAME_COVER * p:
            kept[s] = (p, n)
        for k in range(1, len(word) + 1):
            covered[word[:k]] = max(covered.get(word[:k], 0), p)
    implied = lambda s: any(s[:k] + "*" in kept for k in range(1, len(s.rstrip("*")) + (s[-1] != "*")))
    return {s: (p + 0.5) / (p + n + 1) for s, (p, n) in kept.items() if not implied(s)}


def fit(stems: dict[str, float], rows: DataFrame) -> Grammar:
    """Logistic regression of the label on the events, around the prior weights, from counts of equal features: bounded by the training rows."""
    g = Grammar(stems)
    names = [f"f{i}" for i in range(len(EVENTS))]

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [[round(x * 4) / 4 for x in g.features(t)] for t in batch.column(0).to_pylist()]
            columns = [pa.array([x[i] for x in got], pa.float64()) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays([*columns, batch.column(1)], [*names, "toxic"])

    bins = rows.select("text", "toxic").mapInArrow(tidy(measure), ", ".join(f"{n} double" for n in names) + ", toxic int")
    bins = bins.groupBy(*names).agg(F.sum((F.col("toxic") > 0).cast("double")).alias("p"), F.count("*").cast("double").alias("n")).collect()
    x = np.array([[1.0, *(r[n] for n in names)] for r in bins])
    p, n = np.array([r.p for r in bins]), np.array([r.n for r in bins])
    w = prior = np.array(PRIOR)
    for _ in range(200):
        q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (n * q - p) + PRIOR_ROWS * (w - prior)
        step = np.linalg.solve((x * (n * q * (1 - q))[:, None]).T @ x + PRIOR_ROWS * np.eye(len(w)), grad)
        w = w - np.clip(step, -2, 2)
        if abs(step).max() < 1e-9:
            break
    g.weights = tuple(w.tolist())
    return g


def scored(docs: DataFrame, grammar: Grammar, name: str) -> DataFrame:
    """``docs`` with the score as a last column of this name."""
    if len({c.lower() for c in docs.columns}) != len(docs.columns):
        raise ValueError("column names must differ")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = pa.array([grammar.score(t) for t in batch.column(batch.schema.get_field_index("text")).to_pylist()], pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, s], [*batch.schema.names, name])

    from pyspark.sql.types import DoubleType, StructField, StructType

    return docs.mapInArrow(tidy(judge), StructType([*docs.schema.fields, StructField(name, DoubleType())]))


def score(docs: DataFrame, grammar: Grammar) -> DataFrame:
    """``docs`` with tox_score in 0..1 and tox_held_out.

    Null or empty text: the score of a text without matches. Null doc_id: tox_held_out is null. Ties and repeated
    rows: each row by its own text, so equal texts have equal scores. Empty table: no rows. Extra columns stay; of
    columns that clash only those of these two names are replaced.
    """
    docs = docs.drop(*[c for c in docs.columns if c.lower() in ("tox_score", "tox_held_out")])
    return scored(docs, grammar, "tox_score").withColumn("tox_held_out", F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0)


def learned(spark: SparkSession, sf_dir: str) -> Grammar:
    return learn(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that score below 0.5.

    Null and empty texts stay, as does a null doc_id; repeated rows go or stay together. Empty table: no rows.
    Extra columns stay, whatever their names.
    """
    (name,) = unused(docs, "tox_score")
    return scored(docs, learned(spark, sf_dir), name).filter(F.col(name) < 0.5).drop(name)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = score(table(spark, sf_dir, "documents").select("doc_id", "text"), learned(spark, sf_dir))
    return d.select("doc_id", F.coalesce("tox_held_out", F.lit(False)).alias("held_out"), F.col("tox_score").alias("score"), (F.col("tox_score") >= 0.5).cast("int").alias("predicted"))
