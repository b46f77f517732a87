"""Toxicity by a weighted finite-state pattern grammar.

The insult transducer is a tree of word beginnings whose weights (log odds) are learned from labelled rows. It is
composed with small transducers for threats, targets, negation and reported speech that change what a match is
worth inside its clause. A document's sum over matched clauses and its rate per word are calibrated to a
probability.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .fitting import fit_logistic, fold, label_counts, logistic, marked, sample, texts_of_sample

FOLDS, HELD_OUT = 3, 1
THRESHOLD = 0.7
#: The bounded samples: documents of either label for the lexicon, and others for calibration.
LEXICON_TOXIC, LEXICON_CLEAN, CALIBRATION_DOCS = 1500, 3000, 2500
#: Lengths of word beginnings, least toxic documents of one, least log odds of a match.
SHORTEST, LONGEST, SUPPORT, LEAST = 3, 8, 5, 2.5

# Function words of the grammar. A threat's verbs come with their forms.
TARGETS = frozenset("you your yours u ur du dir ihr tu toi vous usted ustedes vosotros ti".split())
SELVES = frozenset("yourself yourselves dich euch te toi-même vous-même".split())
NEGATIONS = frozenset("not never no nobody cannot nicht kein keine nie niemand pas jamais aucun nunca jamás nadie".split())
REPORTS = frozenset("said says wrote called quoted reported claimed sagte schrieb nannte dit écrit appelé dijo escribió llamó".split())
INTENTS = frozenset("will shall gonna going want werde werden wollen vais allons vas va voy vamos".split())
CONTRASTS = frozenset("but however aber sondern mais pero sino".split())
THREATS = frozenset(
    "kill kills killing killed hurt hurts hurting destroy destroys destroying burn burns burning shoot shoots shooting beat beats beating murder murdering stab stabbing"
    " töten töte schlagen schlage verbrennen verbrenne umbringen tuer tue frapper frappe brûler brûle matar mato golpear golpeo quemar quemo".split()
)
#: A contraction with "not", a word, or the end of a clause.
_TOKEN = re.compile(r"[^\W\d_]+n['’]t(?![^\W_])|[^\W\d_]+(?:-même)?|[.!?;\n]")


@dataclass(frozen=True)
class Transducer:
    """A deterministic weighted transducer over token classes; a missing arc stays in its state with weight 1.

    An arc of three ends a threat: the pattern itself is worth something, whatever its words are worth alone.
    """

    start: str
    arcs: dict = field(hash=False)

    def step(self, state: str, symbol: str) -> tuple[str, float, bool]:
        to, weight, *ends = self.arcs.get((state, symbol), (state, 1.0))
        return to, weight, bool(ends)


#: Classes: insult, threat, target, self, negation, report, intent, contrast, word, end of clause.
SYMBOLS = "ITYSNRVCW#"
#: An insult after its target in a clause is worth more.
TARGET = Transducer("-", {("-", "Y"): ("y", 1.0), ("-", "S"): ("y", 1.0), ("y", "I"): ("y", 1.5), ("y", "#"): ("-", 1.0)})
#: Intent, a threat's verb and then its target, with up to two words between; intent, object, verb; or the verb and a self.
THREAT = Transducer(
    "-",
    {("v", "S"): ("vs", 1.0), ("vs", "T"): ("-", 1.0, "threat"), ("vs", "W"): ("v", 1.0), ("vs", "#"): ("-", 1.0)}
    | {("-", "V"): ("v", 1.0), ("v", "T"): ("t2", 1.0), ("-", "T"): ("b", 1.0), ("b", "S"): ("-", 1.0, "threat"), ("b", "V"): ("v", 1.0)}
    | {("b", c): ("-", 1.0) for c in "IYNRCW"}
    | {(t, c): ("-", 1.0, "threat") for t in ("t0", "t1", "t2") for c in "YS"}
    | {(f"t{k}", c): (f"t{k - 1}", 1.0) for k in (1, 2) for c in "INRVCW"}
    | {("t0", c): ("-", 1.0) for c in "INRVCW"}
    | {(s, "#"): ("-", 1.0) for s in ("v", "b", "t0", "t1", "t2")},
)
#: A match is worth a quarter within five tokens after a negation, up to a contrast or the clause's end.
NEGATION = Transducer(
    "0",
    {(s, "N"): ("5", 1.0) for s in "012345"}
    | {(str(k), c): (str(k - 1), 0.25 if c in "ITYS" else 1.0) for k in range(1, 6) for c in "ITYSRVW"}
    | {(s, c): ("0", 1.0) for s in "12345" for c in "#C"},
)
#: After a verb of report a match is worth half until the clause ends.
REPORTED = Transducer("-", {("-", "R"): ("r", 1.0)} | {("r", c): ("r", 0.5) for c in "ITYS"} | {("r", "#"): ("-", 1.0)})
PARTS = (TARGET, THREAT, NEGATION, REPORTED)


def compose(parts: tuple[Transducer, ...]) -> tuple[int, dict[str, list[tuple[int, float, bool]]]]:
    """The product of the parts, weights multiplied along each arc: its start, and per symbol the arcs by state."""
    seen = {tuple(p.start for p in parts): 0}
    todo, arcs = list(seen), {s: [] for s in SYMBOLS}
    rows: dict[tuple[int, str], tuple[int, float, bool]] = {}
    while todo:
        state = todo.pop()
        for symbol in SYMBOLS:
            moves = [p.step(s, symbol) for p, s in zip(parts, state)]
            to = tuple(m[0] for m in moves)
            if to not in seen:
                seen[to] = len(seen)
                todo.append(to)
            rows[seen[state], symbol] = (seen[to], math.prod(m[1] for m in moves), any(m[2] for m in moves))
    for i, symbol in product(range(len(seen)), SYMBOLS):
        arcs[symbol].append(rows[i, symbol])
    return 0, arcs


@dataclass
class Model:
    lexicon: dict[str, float]
    weights: list[float]


class Grammar:
    """Scores texts with a lexicon of word beginnings (an entry ending in ``$`` is a whole word)."""

    #: What a threat is worth before the grammar's factors.
    THREAT_WEIGHT = 10.0

    def __init__(self, lexicon: dict[str, float], parts: tuple[Transducer, ...] = PARTS):
        self.lexicon, self.roots = lexicon, {k[:SHORTEST] for k in lexicon}
        self.start, self.arcs = compose(parts)
        classes = (("V", INTENTS), ("T", THREATS), ("R", REPORTS), ("C", CONTRASTS), ("N", NEGATIONS), ("Y", TARGETS), ("S", SELVES))
        self.words = {w: c for c, ws in classes for w in ws} | dict.fromkeys(".!?;\n", "#")

    def insult(self, word: str) -> float:
        """The weight of the longest known beginning, 0 if that isn't enough of an insult."""
        if (whole := self.lexicon.get(word + "$")) is not None:
            return whole if whole > LEAST else 0.0
        for k in range(min(len(word), LONGEST), SHORTEST - 1, -1):
            if (w := self.lexicon.get(word[:k])) is not None:
                return w if w > LEAST else 0.0
        return 0.0

    def clauses(self, text: str) -> tuple[list[float], int]:
        """Scores of the clauses with a match, and the number of words."""
        tokens = _TOKEN.findall(text.lower())
        roots, words = self.roots, self.words
        worth = {i: v for i, t in enumerate(tokens) if t[:SHORTEST] in roots and (v := self.insult(t))}
        n = sum(1 for t in tokens if words.get(t) != "#")
        if not worth and not any(words.get(t) == "T" for t in tokens):
            return [], n
        found, now, state, arcs = [], 0.0, self.start, self.arcs
        for i, t in enumerate(tokens):
            symbol = "I" if i in worth else words.get(t) or ("N" if t.endswith(("n't", "n’t")) else "W")
            state, weight, threat = arcs[symbol][state]
            now += (worth[i] * weight if symbol == "I" else 0.0) + (self.THREAT_WEIGHT * weight if threat else 0.0)
            if symbol == "#" and now:
                found.append(now)
                now = 0.0
        return found + [now] * (now > 0), n

    def features(self, text: str | None) -> list[float]:
        scores, n = self.clauses(text) if text else ([], 0)
        total = sum(scores)
        rate = 100 * total / max(n, 20)
        return [1.0, math.log1p(total), math.log1p(rate), float(total > 0)]


def _beginnings(rows: DataFrame) -> DataFrame:
    """(label, entry) for each distinct word beginning and whole word of each document."""
    words = F.array_distinct(F.expr(r"regexp_extract_all(lower(text), '[\\p{L}]+', 0)"))

    def of_length(k: int):
        long = F.filter("w", lambda x: F.length(x) >= k)
        return F.transform(long, lambda x: F.substring(x, 1, k))

    cut = F.concat(*map(of_length, range(SHORTEST, LONGEST + 1)), F.transform("w", lambda x: F.concat(x, F.lit("$"))))
    return rows.select("label", words.alias("w")).select("label", F.explode(F.array_distinct(cut)).alias("entry"))


def learn_lexicon(rows: DataFrame) -> dict[str, float]:
    """Log odds of the beginnings that mark toxic documents, and of the longer ones below them."""
    totals = label_counts(rows)
    nt, nc = totals.get(1, 0), totals.get(0, 0)
    if not nt or not nc:
        return {}
    counts = _beginnings(rows).groupBy("entry").agg(F.count_if(F.col("label") == 1).alias("a"), F.count_if(F.col("label") == 0).alias("b"))
    odds = F.log((F.col("a") + 0.5) / (nt + 1)) - F.log((F.col("b") + 0.5) / (nc + 1))
    counts = counts.where(F.col("a") + F.col("b") >= SUPPORT).withColumn("odds", odds).withColumn("hot", (F.col("a") >= SUPPORT) & (F.col("odds") > LEAST))
    # of a bounded sample: entries above and below a hot one, at most
    hot = counts.where("hot").select(F.substring("entry", 1, SHORTEST).alias("root")).distinct()
    near = counts.withColumn("root", F.substring("entry", 1, SHORTEST)).join(hot, "root", "left_semi").where(F.length("entry") >= SHORTEST)
    return {r.entry: r.odds for r in near.select("entry", "odds").collect()}


def _features(lexicon: dict[str, float]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = Grammar(lexicon)
        for b in batches:
            x = [g.features(t) for t in b.column(b.schema.get_field_index("text")).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index("label")), pa.array(x, pa.list_(pa.float64()))], ["label", "x"])

    return run


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Fit on bounded samples of labelled rows outside the held-out fold: the lexicon on three quarters of them, the calibration on the others."""
    marks = marked(labels, "toxic", FOLDS, HELD_OUT)
    part = F.pmod(F.xxhash64("id", F.lit(7)), F.lit(4))
    own, rest = marks.where(part > 0), marks.where(part == 0)
    lexicon = learn_lexicon(texts_of_sample(docs, sample(own, 1, LEXICON_TOXIC).union(sample(own, 0, LEXICON_CLEAN)), "lexicon"))
    counts = label_counts(rest)
    rest = texts_of_sample(docs, sample(rest, 1, CALIBRATION_DOCS).union(sample(rest, 0, CALIBRATION_DOCS)), "calibration")
    got = rest.mapInArrow(_features(lexicon), "label int, x array<double>").collect()
    return Model(lexicon, fit_logistic(np.array([r.x for r in got], float), np.array([r.label for r in got], float), counts))


def _score(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        g = Grammar(m.lexicon)
        for b in batches:
            p = [logistic(g.features(t), m.weights) for t in b.column(b.schema.get_field_index("text")).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(p, pa.float64())], [*b.schema.names, "score"])

    return run


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with a score of 0 to 1: the probability that a text's toxicity label is 1.

    Reads the whole text and nothing else. Null and empty texts get the score of a text without matches. Columns
    of ``docs`` come back as they are; one named ``score`` is replaced. An empty table stays empty.
    """
    known = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.drop("score")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(_score(known), f"{kinds}, score double")


def toxicity_scores(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted of each document, by a model of the rows that aren't held out.

    A row with a null doc_id is held out of nothing (held_out is false) and is scored like any other.
    """
    out = score(docs.select("doc_id", F.col("text").cast("string").alias("text")), train(docs, labels))
    return out.select(
        "doc_id",
        F.coalesce(fold("doc_id", FOLDS) == HELD_OUT, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )
