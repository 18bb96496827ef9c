"""Toxicity: a weighted finite-state pattern grammar over clauses.

Token classes of a clause (insult, threat, target, negation, reporting verb) are a tape.  Transducers
are composed, each reading the tape that the one before it wrote: reported speech and negation mark
the insults and threats in their scope as soft, the next ones mark insults, threats and targets that
meet, and the last gives each marked symbol a weight.  The insult class is learned from a bounded
labelled sample as whole words and word stems; the other classes are short closed lists.  A word
counts as learned evidence by the number of different contexts (neighbouring words) in which toxic
and clean documents hold it, so that copies of one toxic document don't make its ordinary words
insults.  A document's score combines the weights of its matched clauses.

Texts without a match, empty and null texts get the score of weight 0.  Long texts are read whole.
Repeated rows are scored one by one, an empty table gives no rows, other columns don't matter.  With
labels of one class only, or none, no insult is learned and all texts but those with threats score alike.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.llm import labelled
from kinfold.llm import words as W
from kinfold.llm.store import Scratch

#: Labelled rows of each class used for fitting, at most.
SAMPLE = 3_000
HELD_OUT_MOD, HELD_OUT_IS = 3, 1
PREDICT_AT = 0.7
#: Bytes of the stems that are tried beside whole words.
STEMS = (4, 5, 6)
#: A learned insult needs this many contexts in toxic documents, and a share of toxic contexts that
#: chance gives to less than ERROR of all features tried (Chernoff bound, Bonferroni correction).
MIN_CONTEXTS = 4
#: Hash parts in which the features are counted.
PARTS = 16
ERROR = 0.01

SCHEMA = "doc_id long, held_out boolean, score double, predicted int"

THREAT = "kill hurt destroy beat burn shoot stab punish murder töten schlagen umbringen tuer frapper matar golpear"
TARGET = "you your yours yourself u he she they him her them du dich dir dein deine ihr euch tu te toi ton ta vous votre tú ti usted ustedes vosotros"
NEGATION = "not no never none without isn't aren't wasn't don't nicht kein keine nie pas jamais aucun nunca jamás sin"
REPORTED = "said says say wrote writes claimed claims called reported quoted alleged according sagte schrieb behauptete laut dit écrit selon dijo escribió según"

#: Symbols of the tape: a class, and marks that transducers add to it.
OTHER, INSULT, THREATS, TARGETS, NEG, REP = range(6)
SOFT, AIMED, STRUCK, SYMBOLS = 8, 16, 32, 64
#: Tokens that a negation, and a target before or after an insult or threat, reach; reported speech
#: reaches to the end of the clause.
NEG_REACH, TARGET_BEFORE_INSULT, TARGET_BEFORE_THREAT, TARGET_AFTER = 2, 4, 3, 3
#: Weights: of an insult alone, what a target adds to it on either side, a threat with a target, and the factor of soft ones.
INSULT_WEIGHT, AIM_WEIGHT, THREAT_WEIGHT, SOFT_FACTOR = 0.4, 0.8, 1.0, 0.2
_PUNCT = np.zeros(256, bool)
_PUNCT[[c for c in range(33, 127) if not chr(c).isalnum()]] = True
#: Last bytes of typographic quotes, dashes and marks: those of two bytes after C2, those of three after E2 80.
_MARK2, _MARK3 = np.zeros(256, bool), np.zeros(256, bool)
_MARK2[[m.encode()[1] for m in "¡«»¿"]] = True
_MARK3[[m.encode()[2] for m in "‐‑‒–—―‘’‚‛“”„‟…‹›"]] = True
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".!?;:"]] = True


@dataclass(frozen=True)
class Transducer:
    """In ``state`` a symbol is read, out[state, symbol] is written, and next[state, symbol] follows."""

    next: np.ndarray
    out: np.ndarray


def _machine(states: int, step: Callable[[int, int], tuple[int, int]]) -> Transducer:
    both = np.array([[step(s, x) for x in range(SYMBOLS)] for s in range(states)], dtype=np.int32)
    return Transducer(both[..., 0], both[..., 1])


def reported() -> Transducer:
    """After a reporting verb, insults and threats are soft up to the end of the clause."""
    return _machine(2, lambda s, x: (int(s or x % 8 == REP), x | SOFT if s and x % 8 in (INSULT, THREATS) else x))


def negated(reach: int = NEG_REACH) -> Transducer:
    """Insults and threats up to ``reach`` tokens after a negation are soft."""
    return _machine(reach + 1, lambda s, x: (reach if x % 8 == NEG else max(s - 1, 0), x | SOFT if s and x % 8 in (INSULT, THREATS) else x))


def aimed(on: int, mark: int, reach: int) -> Transducer:
    """Marks symbols of class ``on`` up to ``reach`` tokens after a target."""
    return _machine(reach + 1, lambda s, x: (reach if x % 8 == TARGETS else max(s - 1, 0), x | mark if s and x % 8 == on else x))


def strikes(trigger: int, mark: int, reach: int = TARGET_AFTER) -> Transducer:
    """Marks targets up to ``reach`` tokens after ``trigger``; after a soft one they are soft too."""

    def step(s: int, x: int) -> tuple[int, int]:
        left, soft = (s + 1) // 2, s and (s + 1) % 2  # 0: none; 2 n - 1: n tokens left; 2 n: and soft
        if x % 8 == trigger:
            return 2 * reach - 1 + bool(x & SOFT), x
        then = 0 if left <= 1 else s - 2
        return then, x | mark | (SOFT if soft else 0) if left and x % 8 == TARGETS else x

    return _machine(2 * reach + 1, step)


def compose(a: Transducer, b: Transducer) -> Transducer:
    """b reads what a writes."""
    nb = len(b.next)
    state = np.arange(nb)[None, :, None]
    read = a.out[:, None, :]
    return Transducer((a.next[:, None, :] * nb + b.next[state, read]).reshape(-1, SYMBOLS), b.out[state, read].reshape(-1, SYMBOLS))


def symbol_weights() -> np.ndarray:
    """What the last tape's symbols weigh."""
    out = np.zeros(SYMBOLS)
    for x in range(SYMBOLS):
        kind, factor = x % 8, SOFT_FACTOR if x & SOFT else 1.0
        if kind == INSULT:
            out[x] = factor * (INSULT_WEIGHT + AIM_WEIGHT * bool(x & AIMED))
        elif kind == THREATS:
            out[x] = factor * THREAT_WEIGHT * bool(x & STRUCK)
        elif kind == TARGETS:
            out[x] = factor * (AIM_WEIGHT * bool(x & AIMED) + THREAT_WEIGHT * bool(x & STRUCK))
    return out


@dataclass(frozen=True)
class Grammar:
    """The composed automaton over the classes: next state and weight for each state and class."""

    next: np.ndarray
    weight: np.ndarray


@lru_cache(maxsize=1)
def grammar() -> Grammar:
    """reported o negation o target-insult o insult-target o target-threat o threat-target o weights.

    An insult alone weighs little, with a target on either side three times as much, and a negated or
    reported one less than an insult alone, even with a target.  States that no tape reaches are left out."""
    whole = reported()
    for part in (negated(), aimed(INSULT, AIMED, TARGET_BEFORE_INSULT), strikes(INSULT, AIMED), aimed(THREATS, STRUCK, TARGET_BEFORE_THREAT), strikes(THREATS, STRUCK)):
        whole = compose(whole, part)
    reached, todo = {0: 0}, [0]
    for s in todo:
        for t in whole.next[s, :6].tolist():
            if t not in reached:
                reached[t] = len(reached)
                todo.append(t)
    return Grammar(np.array([[reached[t] for t in whole.next[s, :6].tolist()] for s in todo], dtype=np.int32), symbol_weights()[whole.out[todo, :6]])


def _class_hashes(words: str) -> np.ndarray:
    return np.sort(_hash_words(words.split()))


def _hash_words(words: list[str]) -> np.ndarray:
    raw = [w.encode() for w in words]
    ends = np.cumsum([len(r) for r in raw])
    return W.hashes(np.frombuffer(b"".join(raw), np.uint8), ends - [len(r) for r in raw], ends, lower=True)


def _outer(data: np.ndarray) -> np.ndarray:
    """Which bytes belong to punctuation that is stripped from the ends of words."""
    out = _PUNCT[data]
    if len(data) > 1 and (data > 127).any():
        two = np.flatnonzero((data[:-1] == 0xC2) & _MARK2[data[1:]])
        three = np.flatnonzero((data[:-2] == 0xE2) & (data[1:-1] == 0x80) & _MARK3[data[2:]])
        for at, n in ((two, 2), (three, 3)):
            for k in range(n):
                out[at + k] = True
    return out


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word without outer punctuation (of a word of nothing else, its last byte), words per document, and clause ends."""
    starts, ends, ptr = W.spans(data, offsets)
    if not len(starts):
        return starts, ends, ptr, np.zeros(0, bool)
    stop = _STOP[data[ends - 1]]
    brk = np.zeros(len(data) + 1, np.int64)
    np.cumsum(data == 10, out=brk[1:])
    stop[:-1] |= brk[starts[1:]] > brk[ends[:-1]]
    stop[ptr[1:][ptr[1:] > 0] - 1] = True
    outer, at = _outer(data), np.arange(len(data))
    after = np.minimum.accumulate(np.where(outer, len(data), at)[::-1])[::-1]
    before = np.maximum.accumulate(np.where(outer, -1, at))
    s, e = after[starts], before[ends - 1] + 1
    bare = s >= ends
    s[bare], e[bare] = ends[bare] - 1, ends[bare]
    return s, e, ptr, stop


def _features(data: np.ndarray, s: np.ndarray, e: np.ndarray) -> list[np.ndarray]:
    """Hash of each word, and of its stem of each length (0 where the word isn't longer)."""
    out = [W.hashes(data, s, e, lower=True)]
    for k in STEMS:
        h = W.mix(W.hashes(data, s, np.minimum(e, s + k), lower=True) ^ np.uint64(k))
        h[e - s <= k] = 0
        out.append(h)
    return out


def _found(h: np.ndarray, sorted_set: np.ndarray) -> np.ndarray:
    if not len(sorted_set) or not len(h):
        return np.zeros(len(h), bool)
    i = np.minimum(np.searchsorted(sorted_set, h), len(sorted_set) - 1)
    return sorted_set[i] == h


def _contexts(known: np.ndarray | None, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct (feature, context) pairs by hash part and label: of whole words, or with ``known``
    of the stems of all other words."""
    for batch, data, offsets in W.slices(batches):
        s, e, ptr, _ = tokens(data, offsets)
        if not len(s):
            continue
        feats = _features(data, s, e)
        pad = np.concatenate([[np.uint64(1)], feats[0], [np.uint64(2)]])
        context = (W.mix(pad[:-2] * np.uint64(3) ^ pad[2:]) & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        label = np.asarray(batch.column(batch.schema.get_field_index("label")))[W.per_doc(ptr)]
        many, new_word = (1, None) if known is None else (len(STEMS), ~_found(feats[0], known))
        f = np.concatenate(feats[:1] if known is None else feats[1:])
        c, y = np.tile(context, many), np.tile(label, many)
        keep = f != 0 if known is None else (f != 0) & np.tile(new_word, many)
        f, c, y = f[keep], c[keep], y[keep]
        part = (f % np.uint64(PARTS)).astype(np.int32)
        order = np.lexsort((c, f, y, part))
        f, c, y, part = f[order], c[order], y[order], part[order]
        new = np.ones(len(f), bool)
        new[1:] = (f[1:] != f[:-1]) | (y[1:] != y[:-1]) | (c[1:] != c[:-1])
        f, c, y, part = f[new], c[new], y[new], part[new]
        cut = np.flatnonzero(np.append(True, (part[1:] != part[:-1]) | (y[1:] != y[:-1]))) if len(f) else np.zeros(0, int)
        rows = list(zip(cut.tolist(), [*cut[1:].tolist(), len(f)], strict=False))
        out = [part[cut], y[cut], [f[i:j].tobytes() for i, j in rows], [c[i:j].tobytes() for i, j in rows]]
        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, (pa.int32(), pa.int32(), pa.binary(), pa.binary()), strict=True)], ["part", "label", "f", "c"])


@dataclass(frozen=True)
class Model:
    insults: np.ndarray  # sorted hashes of words and stems
    bias: float
    slope: float

    def weights(self, data: np.ndarray, offsets: np.ndarray, auto: Grammar) -> np.ndarray:
        """Sum of the clause weights of each text."""
        s, e, ptr, stop = tokens(data, offsets)
        out = np.zeros(len(offsets) - 1)
        if not len(s):
            return out
        cls = np.zeros(len(s), np.int8)
        feats = _features(data, s, e)
        for k, listed in ((REP, REPORTED), (NEG, NEGATION), (TARGETS, TARGET), (THREATS, THREAT)):
            cls[_found(feats[0], _class_hashes(listed))] = k
        for h in feats:
            cls[_found(h, self.insults)] = INSULT
        hit = np.flatnonzero((cls == INSULT) | (cls == THREATS))
        if not len(hit):
            return out
        last = np.flatnonzero(stop)
        clause = np.unique(np.searchsorted(last, hit))
        begin, end = np.where(clause > 0, last[clause - 1] + 1, 0), last[clause] + 1
        following, weights = auto.next.tolist(), auto.weight.tolist()
        for doc, i, j in zip((np.searchsorted(ptr, begin, side="right") - 1).tolist(), begin.tolist(), end.tolist(), strict=True):
            state, weight = 0, 0.0
            for c in cls[i:j].tolist():
                weight += weights[state][c]
                state = following[state][c]
            out[doc] += weight
        return out

    def probability(self, weight: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.bias + self.slope * np.log1p(weight), -40, 40)))


def _learn_part(table: pa.Table) -> pa.Table:
    """Insults among the features of one hash part."""
    both = []
    y = np.asarray(table.column("label").combine_chunks())
    for k in (0, 1):
        rows = table.filter(pa.array(y == k))
        both.append(tuple(np.frombuffer(b"".join(rows.column(n).to_pylist()), t) for n, t in (("f", np.uint64), ("c", np.uint32))))
    return pa.table({"f": pa.array(_beyond_chance(*both).view(np.int64), pa.int64())})


def learn_insults(drawn: DataFrame) -> np.ndarray:
    """Sorted hashes of the words, and then of the stems, that belong to toxic documents.

    A stem counts only by words that aren't learned as such, or the stem of an insult would catch
    other words.  Contexts are counted on the executors by hash parts; what is learned is small."""
    known = None
    for _ in range(2):
        found = drawn.mapInArrow(partial(_contexts, known), "part int, label int, f binary, c binary").groupBy("part").applyInArrow(_learn_part, "f long")
        got = np.array([r.f for r in found.collect()], dtype=np.int64).view(np.uint64)
        known = np.unique(got) if known is None else np.union1d(known, got)
    return known


def _beyond_chance(clean: tuple[np.ndarray, np.ndarray], toxic: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    counts = []
    for f, c in (clean, toxic):
        order = np.lexsort((c, f))
        f, c = f[order], c[order]
        new = np.ones(len(f), bool)
        new[1:] = (f[1:] != f[:-1]) | (c[1:] != c[:-1])
        counts.append(np.unique(f[new], return_counts=True))
    (other, n_other), (feature, n) = counts
    if not len(feature):
        return np.zeros(0, np.uint64)
    base = n.sum() / max(1, n_other.sum() + n.sum())
    i = np.minimum(np.searchsorted(other, feature), max(0, len(other) - 1))
    n_clean = np.where(other[i] == feature, n_other[i], 0) if len(other) else np.zeros(len(feature))
    share = n / (n + n_clean)
    with np.errstate(divide="ignore", invalid="ignore"):
        far = n * np.log(share / base) + np.where(n_clean > 0, n_clean * np.log((1 - share) / max(1 - base, 1e-9)), 0.0)
    return feature[(n >= MIN_CONTEXTS) & (n_clean <= 0.05 * n) & (far >= np.log(PARTS * len(feature) / ERROR))]


def calibrate(weight: np.ndarray, y: np.ndarray, prior: float) -> tuple[float, float]:
    """Bias and slope of a logistic curve over log(1 + weight), by damped Newton steps."""
    x = np.column_stack([np.ones(len(y)), np.log1p(weight)])
    share = min(max(y.mean() if len(y) else 0.5, 1e-3), 1 - 1e-3)
    importance = np.where(y > 0, prior / share, (1 - prior) / (1 - share))
    b = np.array([np.log(prior / (1 - prior)), 0.0])
    ridge = np.diag([1e-3, 5e-2])
    for _ in range(40 if len(y) else 0):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        h = (x * (importance * p * (1 - p))[:, None]).T @ x + ridge
        b += np.clip(np.linalg.solve(h, x.T @ (importance * (y - p)) - ridge @ b), -1, 1)
    return float(b[0]), float(b[1])


def fit(docs: DataFrame, labels: DataFrame, train=None, *, label: str = "toxic", limit: int = SAMPLE) -> Model:
    """Learns on at most ``limit`` rows of each class; the learned hashes and a weight for each row reach the driver."""
    train = F.lit(True) if train is None else train
    scratch = Scratch(docs.sparkSession, "toxicity")
    drawn = scratch.write(labelled.of_each(docs, labels, label, train, limit))  # three passes read it
    share = labels.where(train & F.col(label).isNotNull()).agg(F.avg(F.col(label).cast("double"))).first()[0]
    insults = learn_insults(drawn)
    first, auto = Model(insults, 0.0, 1.0), grammar()

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in W.slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("label")), pa.array(first.weights(data, offsets, auto))], ["label", "w"])

    got = drawn.mapInArrow(weigh, "label int, w double").toArrow()
    w, y = np.array(got.column("w"), dtype=float), np.array(got.column("label"), dtype=float)
    order = np.lexsort((w, y))
    scratch.drop(drawn)
    return Model(insults, *calibrate(w[order], y[order], min(max(share or 0.0, 1e-3), 0.5)))


def score(docs: DataFrame, model: Model, *, at: float = PREDICT_AT) -> DataFrame:
    """Score and prediction of each input row, in one pass without a shuffle."""
    auto = grammar()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in W.slices(batches):
            p = model.probability(model.weights(data, offsets, auto))
            ids = [batch.column(batch.schema.get_field_index(k)) for k in ("doc_id", "held_out")]
            yield pa.RecordBatch.from_arrays([*ids, pa.array(p), pa.array((p >= at).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    held = labelled.fold(F.col("doc_id"), HELD_OUT_MOD) == HELD_OUT_IS
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", held.alias("held_out")).mapInArrow(run, SCHEMA)


def keep_clean(docs: DataFrame, model: Model, *, at: float = PREDICT_AT) -> DataFrame:
    """The documents whose score is below ``at``, with all their columns, in the same single pass."""
    auto, names = grammar(), docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in W.slices(batches):
            yield batch.filter(pa.array(model.probability(model.weights(data, offsets, auto)) < at))

    return docs.mapInArrow(run, docs.schema).select(*names)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return score(docs, fit(docs, labels, labelled.fold(F.col("doc_id"), HELD_OUT_MOD) != HELD_OUT_IS))
