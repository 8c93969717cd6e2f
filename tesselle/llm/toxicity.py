"""Toxicity by a weighted finite-state pattern grammar.

Words are read as symbols: insult, threat, target, negation, report, link (articles and forms of "to be"), intent ("will"), or
other; a clause ends with a symbol of its own. Transducers rewrite the symbols from left to right and put marks on
insults and threats:

* the insult transducer accepts an insult after a link, at either edge of its clause, or piled on another insult of the
  same clause or the two before;
* the threat transducer accepts a threat after an intent;
* the target transducer accepts either one after a target, or before one;
* the negation and the reported-speech transducer mark what they govern, so that it counts less.

Their composition, built as far as it is needed, reads a text in one pass and multiplies the weights of a path. Only accepted
insults and threats score: a word alone, amid a clause that no pattern fits, has no score. A logistic model turns a
document's clause scores into a probability.

Insults are learned from labels, as stems: beginnings of words, or whole words, whose distinct contexts (the word, and those
before and after it) stand far more often in toxic documents. Counting contexts, not documents, keeps passages and copies
from voting more than once.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, checkpoint, held_out, mix, small_batches
from .decontaminate import PLAIN

INSULT, THREAT, TARGET, NEGATION, REPORT, LINK, INTENT, OTHER, END = "insult", "threat", "target", "negation", "report", "link", "intent", "other", "end"
KINDS = (INSULT, THREAT, TARGET, NEGATION, REPORT, LINK, INTENT, OTHER, END)
STRONG = (INSULT, THREAT)
#: Fixed word lists of the grammar, in the languages of the documents.
LISTS = {
    TARGET: "you your yours yourself they them these those this that he she him her it who people du dich dir ihr euch sie er ihn wer leute tu toi te vous ils elles il elle lui qui gens tú ti usted ustedes vosotros él ella ellos quien gente ese esa este esta",
    NEGATION: "not no never nobody without nicht kein keine nie niemals ohne ne pas jamais sans nunca jamás sin",
    REPORT: "said says say wrote writes called calls claimed reported quoted sagte sagt schrieb nannte dit disait écrit appelle dijo dice escribió llamó",
    THREAT: "kill murder destroy hurt töten ermorden vernichten tuer détruire frapper matar destruir golpear",
    LINK: "a an the such is are was were be been being ein eine einen einem einer der die das den dem des ist sind war bist seid un une le la les du est sont una el los las del son era eres",
    INTENT: "will shall gonna going must werde werden wird soll vais va allons veux voy vamos quiero debo",
}
#: Fixed strength of a threat; those of insults are learned.
THREATENS = 3.0
LINKED, EDGE, PILED, INTENDED, AIMED, NEGATED, REPORTED, LAST, BACK = (1 << k for k in range(9))
#: Marks by which a word is accepted at once, and those by which it is accepted after all while it is the last strong one.
ACCEPTS = {INSULT: LINKED | EDGE | PILED | AIMED, THREAT: INTENDED | AIMED}
RETRO = {INSULT: PILED | LAST | BACK, THREAT: BACK}
WEIGHTS = {AIMED: 1.3, PILED: 1.2, BACK: 1.2, NEGATED: 0.3, REPORTED: 0.5}
CLAUSE = re.compile(rb"[.;:!?\n|]+")
#: Words whose contexts are told apart together.
AT_ONCE = 50_000
#: A stem has so many bytes at least and at most; shorter words are known as a whole only.
SHORT, LONG = 4, 9


class Transducer:
    """States from 0 on, the start, with arcs (state, kind) to (state, marks); other kinds lead to `rest` without a mark."""

    def __init__(self, arcs: dict[tuple[int, str], tuple[int, int]], rest: dict[int, int]):
        self.arcs, self.rest = arcs, rest

    def step(self, state: int, kind: str) -> tuple[int, int]:
        return self.arcs.get((state, kind)) or (self.rest[state], 0)


def after(trigger: Iterable[str], governed: Iterable[str], mark: int, reach: int | None) -> Transducer:
    """Marks the governed symbols after a trigger, within `reach` symbols or up to the clause's end."""
    last = reach or 1
    rest = {0: 0} | {k: k if reach is None else (k + 1) % (last + 1) for k in range(1, last + 1)}
    arcs = {(k, g): (rest[k], mark) for k in range(1, last + 1) for g in governed}
    for k in rest:
        arcs |= {(k, t): (1, arcs.get((k, t), (0, 0))[1]) for t in trigger}
        arcs[k, END] = (0, 0)
    return Transducer(arcs, rest)


def edges() -> Transducer:
    """EDGE for an insult that begins a clause, LAST at the end of a clause that an insult ends."""
    arcs = {(0, INSULT): (2, EDGE), (1, INSULT): (2, 0), (2, INSULT): (2, 0)}
    return Transducer(arcs | {(0, END): (0, 0), (1, END): (0, 0), (2, END): (0, LAST)}, {0: 1, 1: 1, 2: 1})


def piled() -> Transducer:
    """PILED for an insult after another one of the same clause (state 1) or the two before (states 2 and 3)."""
    arcs = {(0, INSULT): (1, 0)} | {(k, INSULT): (1, PILED) for k in (1, 2, 3)}
    return Transducer(arcs | {(1, END): (2, 0), (2, END): (3, 0), (3, END): (0, 0)}, {0: 0, 1: 1, 2: 2, 3: 3})


class Composed:
    """Transducers that read the same symbols: a state is one of each, marks add up. Arcs are made when first taken."""

    def __init__(self, *parts: Transducer):
        self.parts = parts
        self.start = (0,) * len(parts)
        self.known: dict[tuple, tuple[tuple, int]] = {}

    def step(self, state: tuple, kind: str) -> tuple[tuple, int]:
        found = self.known.get((state, kind))
        if found is None:
            steps = [p.step(s, kind) for p, s in zip(self.parts, state, strict=True)]
            marks = 0
            for _, m in steps:
                marks |= m
            found = self.known[state, kind] = tuple(s for s, _ in steps), marks
        return found


def grammar() -> Composed:
    insult = [after([LINK], [INSULT], LINKED, 3), edges(), piled()]
    threat = [after([INTENT], [THREAT], INTENDED, 3)]
    target = [after([TARGET], STRONG, AIMED, 4), after(STRONG, [TARGET], BACK, 3)]
    return Composed(*insult, *threat, *target, after([NEGATION], STRONG, NEGATED, 3), after([REPORT], STRONG, REPORTED, None))


def weight(marks: int, weights: dict[int, float]) -> float:
    out = 1.0
    for mark, factor in weights.items():
        if marks & mark:
            out *= factor
    return out


def parse(clauses: list[list[tuple[str, float]]], machine: Composed, weights: dict[int, float] = WEIGHTS) -> tuple[list[float], int]:
    """The scores of clauses with accepted words, and the number of these words. Clauses are lists of (kind, strength).

    A word that isn't accepted at once waits until another strong one is read, or a mark accepts it after all; it then
    counts for the clause in which that mark is.
    """
    state, waiting, retro, scores, accepted = machine.start, 0.0, 0, [], 0
    for clause in clauses:
        score = 0.0
        for kind, strength in [*clause, (END, 0.0)]:
            state, marks = machine.step(state, kind)
            if marks & retro:
                score += waiting * weight(marks & BACK, weights)
                retro, accepted = 0, accepted + 1
            if kind in STRONG:
                waiting, retro = strength * weight(marks, weights), RETRO[kind]
                if marks & ACCEPTS[kind]:
                    score += waiting
                    retro, accepted = 0, accepted + 1
        if score:
            scores.append(score)
    return scores, accepted


def head(word: bytes) -> bytes:
    """The key of a word in the tally: its first bytes, or all of it and a sign that it ends there."""
    return word[:LONG] if len(word) > LONG else word + b"$"


class Kinds(dict):
    """(kind, strength) of words, each found once. Words of the fixed lists keep their kind, of learned stems the longest
    counts. Emptied when large."""

    def __init__(self, insults: dict[bytes, float]):
        super().__init__()
        self.insults, self.begins = insults, {x[:SHORT] for x in insults}
        self.fixed = {w.encode(): (kind, THREATENS if kind == THREAT else 0.0) for kind, text in LISTS.items() for w in text.split()}

    def __missing__(self, word: bytes) -> tuple[str, float]:
        if len(self) > 200_000:
            self.clear()
        key = head(word)
        likely = key[:SHORT] in self.begins and word not in self.fixed  # most words begin as no stem does
        stems = [key, *(word[:n] for n in range(min(LONG, len(word)), SHORT - 1, -1))] if likely else []
        learned = next((self.insults[x] for x in stems if x in self.insults), None)
        found = self[word] = self.fixed.get(word, (OTHER, 0.0)) if learned is None else (INSULT, learned)
        return found


class Scorer:
    def __init__(self, insults: dict[bytes, float], coefficients: np.ndarray | None = None, marks: dict[int, float] = WEIGHTS):
        self.insults, self.coefficients, self.marks = insults, coefficients, marks

    def __getstate__(self):
        return self.insults, self.coefficients, self.marks

    def __setstate__(self, state):
        self.__init__(*state)

    def ready(self) -> Scorer:
        """Makes what a worker needs to read texts."""
        self.kinds, self.machine = Kinds(self.insults), grammar()
        return self

    def features(self, text: str | None) -> np.ndarray:
        """Constant; logarithms of the sum of clause scores, of the clauses accepted and of accepted words for a hundred
        words; the best clause."""
        out = np.array([1, 0, 0, 0, 0], float)
        raw = (text or "").lower().encode("utf-8", "surrogatepass")
        known = self.kinds
        words = raw.translate(PLAIN).split()
        if not any([known[w][1] for w in words]):
            return out
        clauses = []
        for clause in CLAUSE.split(raw):
            symbols = [known[w] for w in clause.translate(PLAIN).split()]
            clauses.append(symbols if any(s for _, s in symbols) else [])  # the end of a clause undoes all other symbols
        scores, accepted = parse(clauses, self.machine, self.marks)
        if scores:
            out[1:] = np.log1p(sum(scores)), np.log1p(len(scores)), np.log1p(100 * accepted / len(words)), max(scores)
        return out

    def score(self, text: str | None) -> float:
        if self.coefficients is None:
            return 0.0
        return float(1 / (1 + np.exp(-np.clip(self.features(text) @ self.coefficients, -30, 30))))


def fit_logistic(x: np.ndarray, y: np.ndarray, share: np.ndarray, penalty: float = 1e-3) -> np.ndarray:
    """Newton steps; `share` holds how many documents a row stands for."""
    w = np.zeros(x.shape[1])
    share = share / share.sum()
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (share * (p - y)) + penalty * w
        bend = (x * (share * p * (1 - p))[:, None]).T @ x + penalty * np.eye(x.shape[1])
        w = w - np.linalg.solve(bend, slope)
    return w


def fit(docs: DataFrame, labels: DataFrame, per_class: int = 4000, ratio: float = 16.0, evidence: float = 20.0, marks: dict[int, float] = WEIGHTS) -> Scorer:
    """Learns from labelled rows that are not held out.

    About `per_class` documents of either label, those with the least hash of the id, are the bound on what is read for
    learning; the stems that they give and five figures for each of them come to the driver, so both are bounded. A stem
    needs `ratio` times as many contexts in toxic documents as its share, and a log-likelihood ratio of at least
    `evidence`. A label repeated for a document counts once, the higher one. Without labels of both kinds, or any
    stem, all scores are 0.
    """
    own = labels.select(F.col("doc_id").cast("long"), F.col("toxic").cast("int")).filter("toxic in (0, 1) and doc_id is not null").filter(~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    counts = {x["toxic"]: x["count"] for x in own.groupBy("toxic").count().collect()}
    if len(counts) < 2:
        return Scorer({})
    part = F.pmod(F.xxhash64("doc_id", F.lit(6)), F.lit(1 << 30))
    limit = [int(min(1, per_class / counts[k]) * (1 << 30)) for k in (0, 1)]
    chosen = own.filter(part < F.when(F.col("toxic") == 1, limit[1]).otherwise(limit[0]))
    texts = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")
    texts = checkpoint(texts.filter("text is not null"))  # about 2 * per_class ids were sent to the scan, so no text is shuffled

    def contexts(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes, heads, around, toxic = WordHashes(), [], [], []

        def tallied() -> pd.DataFrame:
            context = np.concatenate([np.empty(0, np.uint64), *around]).view(np.int64)
            rows = pd.DataFrame({"head": heads, "context": context, "toxic": np.array(toxic, np.int32)})
            return rows.drop_duplicates(["context", "toxic"])  # the context is a hash of the word, too

        for frame in frames:
            for text, label in zip(frame["text"], frame["toxic"], strict=True):
                words = text.lower().encode("utf-8", "surrogatepass").translate(PLAIN).split()
                padded = np.concatenate([[np.uint64(0)], hashes.of(words), [np.uint64(0)]])
                around.append(mix(mix(mix(padded[:-2] + np.uint64(1)) + padded[1:-1]) + padded[2:]))
                heads += [head(w) for w in words]
                toxic += [label] * len(words)
                if len(heads) > AT_ONCE:
                    yield tallied()
                    heads, around, toxic = [], [], []
        yield tallied()

    seen = texts.mapInPandas(contexts, "head binary, context long, toxic int").distinct()
    tally = checkpoint(seen.groupBy("head").agg(F.sum("toxic").alias("bad"), F.sum(1 - F.col("toxic")).alias("good")))
    total = tally.agg(F.sum("bad"), F.sum("good")).first()
    bads, goods = float(total[0] or 0), float(total[1] or 0)
    if not bads or not goods:
        return Scorer({})
    ends = F.expr("endswith(head, X'24')")
    size = F.length("head") - F.when(ends, 1).otherwise(0)
    stems = F.transform(F.when(size >= SHORT, F.sequence(F.lit(SHORT), F.least(size, F.lit(LONG)))).otherwise(F.array().cast("array<int>")), lambda n: F.substring("head", F.lit(1), n))
    stems = F.concat(stems, F.when(ends, F.array("head")).otherwise(F.array().cast("array<binary>")))
    tally = tally.select(F.explode(stems).alias("stem"), "bad", "good").groupBy("stem").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    share = bads / (bads + goods)
    n = F.col("bad") + F.col("good")
    odds = (F.col("bad") / bads) / ((F.col("good") + 0.5) / goods)
    term = lambda c, s: F.when(F.col(c) > 0, F.col(c) * F.log(F.col(c) / (n * s))).otherwise(0.0)
    strength = 2 * (term("bad", share) + term("good", 1 - share))
    strong = tally.withColumn("odds", odds).filter((F.col("odds") >= ratio) & (strength >= evidence))
    insults = {bytes(x["stem"]): round(float(np.log(x["odds"])), 6) for x in strong.select("stem", "odds").collect()}
    if not insults:
        return Scorer({})
    scorer = docs.sparkSession.sparkContext.broadcast(Scorer(insults, marks=marks))

    def measured(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = scorer.value.ready()
        for frame in frames:
            x = np.array([own.features(t) for t in frame["text"]]).reshape(-1, 5)
            yield pd.DataFrame(x, columns=list("abcde")).assign(toxic=frame["toxic"].to_numpy())

    rows = texts.mapInPandas(measured, "a double, b double, c double, d double, e double, toxic int").toPandas().sort_values([*"abcde", "toxic"])
    y = rows["toxic"].to_numpy(float)
    weight_ = np.where(y == 1, counts[1] / max(1, y.sum()), counts[0] / max(1, (1 - y).sum()))
    return Scorer(insults, fit_logistic(rows[list("abcde")].to_numpy(), y, weight_), marks)


def score(docs: DataFrame, scorer: Scorer, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted for each row; null and empty texts score as a text without matches.

    A null id is not held out. Repeated rows give repeated results. Whole texts are read, however long. Columns other
    than the id and the text are ignored. No rows give none.
    """
    shared = docs.sparkSession.sparkContext.broadcast(scorer)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = shared.value.ready()
        for frame in frames:
            found = np.array([own.score(x) for x in frame["text"]], float)
            yield frame.drop(columns="text").assign(score=found, predicted=(found >= threshold).astype(np.int32))

    rows = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInPandas(run, "doc_id long, held_out boolean, score double, predicted int")
