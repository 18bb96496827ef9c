"""The training-data operators against brute force, SQL, round trips and held-out labels, and on edge cases."""

import hashlib
import os
import random
import re
import zlib
from collections import Counter, defaultdict
from math import log

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinfold.llm import ann, jaccard, labelled, lm_score, mixing, packing, quality_fm, quality_rules, sharding, substring, toxicity, trees
from kinfold.llm.queries import QUERIES, SQL
from kinfold.llm.store import Scratch

SF = "/root/testdata/sf0.001"
tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, texts, first=0):
    rows = [(first + i, t, random.Random(i).choice(["en", "de", None]), f"src{i % 4}" if i % 7 else None, len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def prose(rng, n, vocabulary=400):
    return [f"w{int(vocabulary * rng.random() ** 2)}" for _ in range(n)]


def corpus(seed=3):
    """Copies, near copies, shared passages, ties, empty and null texts, odd spaces and one long text."""
    rng = random.Random(seed)
    base = [prose(rng, rng.randint(1, 120)) for _ in range(25)]
    passage = prose(rng, 45)
    out = []
    for b in base:
        out.append(b)
        near = list(b)
        for _ in range(rng.choice([0, 0, 1, 2, 6])):
            near[rng.randrange(len(near))] = "changed"
        out.append(near)
        if rng.random() < 0.4:
            at = rng.randrange(len(b) + 1)
            out.append(b[:at] + passage + b[at:])
    texts = [" ".join(x) for x in out]
    texts += [texts[0]] * 5 + [texts[0].upper(), "", "", None, None, " \n\t ", "one", "One two", "one  two", " ".join(passage * 3), " ".join(prose(rng, 30_000, 5_000)), "a b c\x0bd", "ünï cödé 漢字 " * 30]
    return texts


# --- n-gram Jaccard join


def shingles(text, n):
    w = WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
    return frozenset([tuple(w)] if w and len(w) < n else [tuple(w[i : i + n]) for i in range(len(w) - n + 1)])


def classes(texts, n, part, whole):
    sets, root = [shingles(t, n) for t in texts], list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            small, large = sorted((len(sets[i]), len(sets[j])))
            if not small or part * small < whole * large:
                continue
            both = len(sets[i] & sets[j])
            if part * both >= whole * (small + large - both):
                a, b = sorted((root[i], root[j]))
                root = [a if r == b else r for r in root]
    return {i: (len(sets[i]), root[i]) for i in range(len(texts))}


@pytest.mark.parametrize(("rule", "tile"), [(jaccard.Rule(), 1024), (jaccard.Rule(), 4), (jaccard.Rule(5, 100, 80), 4)])
def test_jaccard_links_every_pair(spark, monkeypatch, rule, tile):
    monkeypatch.setattr(jaccard, "TILE", tile)  # groups beyond a tile take the blocked way
    texts = corpus()
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.join(frame(spark, texts), rule).collect()}
    assert got == classes(texts, rule.shingle, rule.part, rule.whole)


def test_jaccard_keeps_one_of_each_class(spark):
    texts = corpus(5)
    docs = frame(spark, texts).withColumn("node", F.lit("x")).withColumn("g", F.lit(1)).withColumn("component_id", F.lit(2))
    kept = jaccard.keep_one(docs)
    assert kept.columns == docs.columns
    root = classes(texts, 5, 100, 80)
    assert sorted(r.doc_id for r in kept.collect()) == [i for i in range(len(texts)) if root[i][1] == i]


def test_jaccard_decides_rows_that_share_an_id_one_by_one(spark):
    rng = random.Random(9)
    a, b, c = (" ".join(prose(rng, 60, 5_000)) for _ in range(3))
    rows = [(1, a), (2, a + " more"), (2, b), (3, b + " more"), (4, c), (4, a), (5, c), (6, ""), (6, a), (None, a)]
    docs = spark.createDataFrame([(i, t, None, None, len(t)) for i, t in rows], SCHEMA).withColumn("node", F.lit("x"))
    kept = jaccard.keep_one(docs)
    assert kept.columns == docs.columns
    # b and c stay with the smallest ids of their groups, though those ids also hold near copies of 1
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr) == sorted([(1, a), (2, b), (4, c), (6, ""), (None, a)], key=repr)


@pytest.mark.parametrize("wide", [1, 2])
def test_jaccard_links_every_pair_of_wide_groups(spark, monkeypatch, wide):
    monkeypatch.setattr(jaccard, "TILE", 4)
    monkeypatch.setattr(jaccard, "WIDE", wide)
    texts = corpus(8)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.join(frame(spark, texts), jaccard.Rule(5, 100, 80)).collect()}
    assert got == classes(texts, 5, 100, 80)


def test_jaccard_takes_groups_of_unlike_texts_apart(spark, monkeypatch):
    """Texts that share a phrase each with the next three are one group by their stars; they don't all meet."""
    passage = " ".join(f"p{k}" for k in range(60))
    phrase = [" ".join(f"{i}-{k}" for k in range(3)) for i in range(103)]
    texts = [" ".join([passage, *phrase[i : i + 4], f"u{i} v{i}"]) for i in range(100)]
    texts += [t + " more" for t in texts[::9]]
    monkeypatch.setattr(jaccard, "TILE", 4)
    rows, dealt = [], jaccard._in_tiles
    monkeypatch.setattr(jaccard, "_in_tiles", lambda tiles, rule: (rows.append(tiles.count() if "text" in tiles.columns else 0), dealt(tiles, rule))[1])
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.join(frame(spark, texts)).collect()}
    assert got == classes(texts, 3, 100, 90)
    assert sum(rows) < 8 * len(texts), rows


# --- LM scoring


def test_backoff_scores(spark):
    texts = corpus(7)
    words = [WORD.findall(t or "") for t in texts]
    counts = [Counter(tuple(w[i : i + n]) for w in words for i in range(len(w) - n + 1)) for n in (1, 2, 3)]
    total = sum(counts[0].values())

    def score(w, i):
        for n in range(min(3, i + 1), 0, -1):
            backed = (min(3, i + 1) - n) * log(lm_score.ALPHA)
            gram = tuple(w[i - n + 1 : i + 1])
            if n == 1:
                return backed + log(counts[0][gram] / total)
            if counts[n - 1][gram] >= lm_score.MIN_COUNT:
                return backed + log(counts[n - 1][gram] / counts[n - 2][gram[:-1]])

    got = {r.doc_id: r for r in lm_score.score(frame(spark, texts)).collect()}
    assert len(got) == len(texts)
    for i, w in enumerate(words):
        assert got[i].n_words == len(w)
        assert got[i].logprob == pytest.approx(sum(score(w, k) for k in range(len(w))), rel=1e-9, abs=1e-9)


def test_ngrams_are_known_by_their_whole_hash(monkeypatch):
    import pyarrow as pa

    near = np.array([2, 3, 4, 2**63, 2**63 + 1, 2**64 - 1], dtype=np.uint64)  # apart in a few bits at either end
    monkeypatch.setattr(lm_score.W, "grams", lambda h, n: near[: len(h)])
    grams, _ = lm_score._grams(pa.table({"text": ["a b c d e f"]}), 1)
    keys, counts, cut = lm_score._listed(grams, 3)
    assert keys.tolist() == near.tolist() and counts.tolist() == [1] * 6 and cut.tolist() == [0, 3, 5, 6]


# --- sharding


def test_shards_follow_the_mixture(spark):
    texts = corpus(11) * 6
    got = sharding.shard(frame(spark, texts)).collect()
    assert len(got) == len(texts) and {r.law for r in got} == {"rows"}
    by = defaultdict(list)
    for r in got:
        t = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.grown_shard) == (len(t) + 1, zlib.crc32(t), None)
        by[r.shard].append(r)
    sizes = [len(by[s]) for s in range(sharding.SHARDS)]
    assert max(sizes) - min(sizes) <= 1
    all_of = Counter(r.source for r in got)
    for rows in by.values():
        assert sorted(r.slot for r in rows) == list(range(len(rows)))
        for source, n in Counter(r.source for r in rows).items():
            assert abs(n - all_of[source] * len(rows) / len(got)) <= 2 * len(all_of)


def test_shards_without_hot_buckets(spark):
    """60,000 sources of one row, and one row a third of all: buckets stay small, the law holds."""
    n = 60_000
    ones = spark.range(n).selectExpr("id AS doc_id", "2L AS size", "7L AS text_crc32", "concat('s', id) AS source")
    placed = sharding.interleave(ones, n)
    assert placed.groupBy("_c").count().agg(F.max("count")).first()[0] < 3 * n / 256
    copies = spark.range(n).selectExpr("if(id % 3 = 0, -1, id) AS doc_id", "'x' AS text", "if(id % 3 = 1, null, 'a') AS source")
    for rows in (placed, sharding.shard(copies)):
        got = rows.groupBy("shard").agg(F.count("*").alias("n"), F.max("slot").alias("last"), F.countDistinct("slot").alias("slots")).collect()
        assert len(got) == 16 and all(r.n == r.slots == r.last + 1 == n // 16 for r in got)


# --- mixing


def test_shortages_go_to_siblings_first():
    assert mixing.fill(100, [1, 1], [10, 500]) == [10, 90]
    assert mixing.fill(100, [3, 1], [500, 500]) == [75, 25]
    assert mixing.fill(100, [1, 2], [10, 20]) == [10, 20]
    tree = mixing.Tree(domains=(("a", 1, "^a"), ("b", 1, "")), percent=50, epochs=1, langs={"en": 1, "de": 1})
    given = mixing.budgets({("a", "en", "a1"): 10, ("a", "de", "a2"): 1000, ("b", "en", "b1"): 1000}, tree)
    assert given[("a", "en", "a1")] == 10
    assert given[("a", "de", "a2")] == 502 - 10  # shares are rounded down: half of 1,005 for a, of which en takes 10
    assert given[("b", "en", "b1")] == 502


def test_mixture_stays_within_each_budget(spark):
    docs = frame(spark, corpus(13) * 4).withColumn("domain", F.lit("x")).withColumn("epoch", F.lit(9))
    rows = mixing.choose(docs).collect()
    tokens = {r.doc_id: len(WORD.findall(r.text or "")) for r in docs.collect()}
    leaves, used, most = defaultdict(int), defaultdict(int), defaultdict(int)
    tree = mixing.Tree()
    for r in docs.collect():
        source = r.source or ""
        domain = next(n for n, _, p in tree.domains if re.search(p, source))
        leaves[domain, r.lang or "", source] += tokens[r.doc_id]
        most[domain, r.lang or "", source] = max(most[domain, r.lang or "", source], tokens[r.doc_id])
    for r in rows:
        assert r.n_tokens == tokens[r.doc_id]
        used[r.domain, r.lang, r.source] += r.n_tokens
    for leaf, given in mixing.budgets(leaves, tree).items():
        assert given - most[leaf] < used[leaf] + 1 and used[leaf] <= given, leaf
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    assert Counter(r.doc_id for r in mixed.collect()) == Counter(r.doc_id for r in rows)


# --- substring dedup


def stripped(texts, n=20):
    words, seen, out = [WORD.findall(t or "") for t in texts], set(), []
    for w in words:
        gone = [False] * len(w)
        for i in range(len(w) - n + 1):
            key = tuple(w[i : i + n])
            if key in seen:
                gone[i : i + n] = [True] * n
            seen.add(key)
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((len(w), sum(gone), kept))
    return out


def test_substring_removes_later_windows(spark):
    texts = corpus(17) + ["x " * 500, "x " * 30]
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in substring.dedup(frame(spark, texts)).collect()}
    assert got == dict(enumerate(stripped(texts)))


@pytest.mark.parametrize("seed", range(4))
def test_nonbranching_paths(spark, seed):
    """Heads and offsets of random graphs, chains, loops and closed paths, against plain walking."""
    rng = random.Random(seed)
    pairs = {(rng.randrange(30), rng.randrange(30)) for _ in range(25)} | {(100 + i, 101 + i) for i in range(37)} | {(200 + i, 200 + (i + 1) % 5) for i in range(5)} | {(300, 300), (301, 302), (302, 303)}
    edges = [(k, -k, u, v, rng.randint(1, 30)) for k, (u, v) in enumerate(sorted(pairs))]
    leave, enter = Counter(e[2] for e in edges), Counter(e[3] for e in edges)
    into = {e[3]: e for e in edges}
    want = {}
    for e in edges:
        at, off, steps = e, 0, 0
        while leave[at[2]] == 1 and enter[at[2]] == 1 and into[at[2]] != at and steps <= len(edges):
            at = into[at[2]]
            off, steps = off + at[4], steps + 1
        want[e[0], e[1]] = (e[0], e[1], 0) if steps > len(edges) else (at[0], at[1], off)
    got = substring.compact(spark.createDataFrame(edges, "a long, b long, u long, v long, many int"), Scratch(spark, "t"))
    assert {(r.a, r.b): (r.ha, r.hb, r.off) for r in got.collect()} == want


def test_spans_are_the_repeats(spark):
    """Edges, nodes and spans of a corpus, against all occurrences by plain Python."""
    docs = frame(spark, corpus(21) + ["x " * 300, " ".join(f"y{i % 90}" for i in range(400))])
    texts = docs.select(F.col("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.lit(0).alias("t"))
    places = texts.mapInArrow(substring._edges, substring.EDGES)
    rows = places.collect()
    first = {}
    for r in sorted(rows, key=lambda r: (r.id, r.start)):
        first.setdefault((r.a, r.b), (r.id, r.start))
    want = defaultdict(set)
    for r in rows:
        if first[r.a, r.b] != (r.id, r.start):
            want[r.id] |= set(range(r.start, r.start + r.many))
    spans = {r.doc_id: r.p for r in substring.repeated_spans(places, Scratch(spark, "t")).collect()}
    assert {d: {w for s in p for w in range(s.start, s.start + s.many)} for d, p in spans.items()} == want
    by = defaultdict(list)
    for r in rows:
        by[r.id].append(r)
    for own in by.values():
        own.sort(key=lambda r: r.start)
        assert all(x.v == y.u and x.start + x.many == y.start for x, y in zip(own, own[1:], strict=False))
    assert sum(map(len, spans.values())) < sum(first[r.a, r.b] != (r.id, r.start) for r in rows)  # compaction joins some


def test_substring_strips_in_place(spark):
    texts = corpus(19)
    docs = frame(spark, texts).withColumn("kept", F.lit("k")).withColumn("path_start", F.lit(1)).withColumn("n_words", F.lit(5))
    out = substring.strip(docs)
    assert out.columns == docs.columns
    want = stripped(texts)
    got = {r.doc_id: r for r in out.collect()}
    assert set(got) == {i for i, (n, gone, _) in enumerate(want) if n == 0 or gone < n}
    for i, r in got.items():
        assert r.text == (want[i][2] if want[i][1] else texts[i])
        assert r.n_chars == len(r.text or "")


# --- classifiers


def auc(score, label):
    order = np.argsort(score, kind="stable")
    rank = np.empty(len(order))
    _, inverse, count = np.unique(score[order], return_inverse=True, return_counts=True)
    rank[order] = (np.cumsum(count) - (count - 1) / 2)[inverse]
    n1 = label.sum()
    return (rank[label == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * (len(label) - n1))


@tables
@pytest.mark.parametrize(("name", "label", "least"), [("op6_quality_classifier", "quality", 0.8), ("op8_toxicity", "toxic", 0.85)])
def test_held_out_labels(spark, name, label, least):
    sf = SF.replace("0.001", "0.01")
    labels = {r.doc_id: r[label] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = QUERIES[name](spark, sf).collect()
    mod, held = (5, 0) if label == "quality" else (3, 1)
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % mod == held) and 0 <= r.score <= 1
        assert r.predicted == (r.score >= (0.3 if label == "quality" else 0.7))
    out = [(r.score, labels[r.doc_id]) for r in rows if r.held_out and labels.get(r.doc_id) is not None]
    score, y = np.array(out, dtype=float).T
    assert auc(score, y) >= least


@tables
def test_held_out_labels_have_no_influence(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    turned = labels.withColumn("toxic", F.when(labelled.fold(F.col("doc_id"), 3) == 1, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    train = labelled.fold(F.col("doc_id"), 3) != 1
    a, b = (toxicity.fit(docs, x, train) for x in (labels, turned))
    assert np.array_equal(a.insults, b.insults) and (a.bias, a.slope) == (b.bias, b.slope)


def test_factorisation_machine_sum_of_squares():
    rng = np.random.default_rng(2)
    m = quality_fm.Machine(0.3, rng.normal(size=quality_fm.BUCKETS + 14), rng.normal(size=(quality_fm.BUCKETS + 14, 3)), np.zeros(2), np.ones(2))
    dense, cls, bucket, value = np.array([[0.5, -1.0]]), np.array([3]), np.array([5, 9, 77]), np.array([0.2, 0.4, 0.1])
    ids = np.concatenate([bucket, quality_fm.BUCKETS + np.arange(2), [quality_fm.BUCKETS + 2 + 3]])
    x = np.concatenate([value, dense[0], [1.0]])
    pairs = sum(m.v[ids[i]] @ m.v[ids[j]] * x[i] * x[j] for i in range(6) for j in range(i))
    assert m.margin(dense, cls, bucket, value, np.array([0, 3]))[0] == pytest.approx(0.3 + m.w[ids] @ x + pairs)


def test_grammar_weighs_matched_clauses():
    auto = toxicity.grammar()
    model = toxicity.Model(np.sort(toxicity._hash_words(["blorp"])), -2.0, 3.0)

    def weight(text):
        raw = text.encode()
        return model.weights(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), auto)[0]

    assert weight("a quiet day") == weight("") == 0 and weight("I will kill time") == 0
    assert weight("you blorp") > weight("blorp") > weight("not blorp") > 0
    assert weight("they said blorp") < weight("you blorp") and weight("we kill you") > 0
    assert weight("you. blorp") == weight("blorp")


def test_grammar_scores_clauses_rather_than_words():
    auto = toxicity.grammar()
    model = toxicity.Model(np.sort(toxicity._hash_words(["blorp"])), -2.0, 3.0)

    def weight(text):
        raw = text.encode()
        return model.weights(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), auto)[0]

    assert weight("blorp you") == weight("you blorp") > 2 * weight("blorp")
    for text in ("you are not blorp", "not blorp you", "they said blorp", "he wrote you blorp", "said blorp you"):
        assert 0 < weight(text) < weight("blorp"), text
    assert 0 < weight("we never kill you") < weight("blorp") < weight("we kill you")
    assert weight("not a word, he is blorp") > weight("blorp")  # a negation far from the insult


def _interpreted(tape):
    """The grammar by its definition, token by token, without automata."""
    t, total = toxicity, 0.0
    soft = [c in (t.INSULT, t.THREATS) and (t.REP in tape[:i] or t.NEG in tape[max(0, i - t.NEG_REACH) : i]) for i, c in enumerate(tape)]
    for i, c in enumerate(tape):
        before = lambda n: tape[max(0, i - n) : i]  # noqa: B023, E731
        if c == t.INSULT:
            total += (t.INSULT_WEIGHT + t.AIM_WEIGHT * (t.TARGETS in before(t.TARGET_BEFORE_INSULT))) * (t.SOFT_FACTOR if soft[i] else 1)
        elif c == t.THREATS:
            total += t.THREAT_WEIGHT * (t.TARGETS in before(t.TARGET_BEFORE_THREAT)) * (t.SOFT_FACTOR if soft[i] else 1)
        elif c == t.TARGETS:
            last = {k: next((j for j in range(i - 1, max(-1, i - 1 - t.TARGET_AFTER), -1) if tape[j] == k), None) for k in (t.INSULT, t.THREATS)}
            factor = t.SOFT_FACTOR if any(j is not None and soft[j] for j in last.values()) else 1
            total += factor * (t.AIM_WEIGHT * (last[t.INSULT] is not None) + t.THREAT_WEIGHT * (last[t.THREATS] is not None))
    return total


def test_automaton_is_the_grammar():
    auto, rng = toxicity.grammar(), random.Random(12)
    tapes = [[rng.choice([0, 0, 1, 2, 3, 3, 4, 5] if k % 2 else [0, 0, 0, 1, 2, 3, 4]) for _ in range(rng.randint(0, 14))] for k in range(4000)]
    for tape in tapes:
        state, weight = 0, 0.0
        for c in tape:
            weight += auto.weight[state, c]
            state = auto.next[state, c]
        assert weight == pytest.approx(_interpreted(tape)), tape


def test_a_text_is_the_sum_of_its_clauses():
    """Words, classes and clauses by plain Python against the vectorised reader."""
    lists = {toxicity.THREATS: toxicity.THREAT, toxicity.TARGETS: toxicity.TARGET, toxicity.NEG: toxicity.NEGATION, toxicity.REP: toxicity.REPORTED}
    of = {w: k for k, listed in lists.items() for w in listed.split()} | {"blorp": toxicity.INSULT}
    model, auto, rng = toxicity.Model(np.sort(toxicity._hash_words(["blorp"])), -2.0, 3.0), toxicity.grammar(), random.Random(3)
    words = ["blorp", "you", "kill", "not", "said", "quiet", "day", "him", "nicht", "dijo"]
    texts = [" ".join(rng.choice(words) + rng.choice(["", "", "", ".", ",", "!", "\n", ";"]) for _ in range(rng.randint(0, 60))) for _ in range(200)] + ["you blorp " * 50_000]
    ends = np.cumsum([0, *(len(t.encode()) for t in texts)])
    got = model.weights(np.frombuffer("".join(texts).encode(), np.uint8), ends, auto)
    for t, w in zip(texts, got, strict=True):
        clauses = [[of.get(x.strip(",.!;"), 0) for x in WORD.findall(c)] for c in re.split(r"(?<=[.!;])\s+|\n", t)]
        assert w == pytest.approx(sum(map(_interpreted, clauses)))


def test_words_lose_all_outer_punctuation():
    texts = ["blorp!!!!!!!!!", '(((((((((("blorp")))))))))).', "“blorp”", "„blorp“…", "«blorp»", "‘blorp’—", "¿¡blorp!", "blorp"]
    raw = " ".join(texts).encode()
    data = np.frombuffer(raw, np.uint8)
    s, e, _, _ = toxicity.tokens(data, np.array([0, len(raw)]))
    assert [raw[i:j] for i, j in zip(s, e, strict=True)] == [b"blorp"] * len(texts)
    model, auto = toxicity.Model(np.sort(toxicity._hash_words(["blorp"])), -2.0, 3.0), toxicity.grammar()
    ends = np.cumsum([0, *(len(t.encode()) for t in texts)])
    weights = model.weights(np.frombuffer("".join(texts).encode(), np.uint8), ends, auto)
    assert (weights == weights[-1]).all() and weights[-1] > 0
    kept = ["a-b", "it’s", "é", "x", "漢字", "naïve"]
    raw = " ".join([*kept, "!?", "…"]).encode()
    s, e, _, _ = toxicity.tokens(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
    assert [raw[i:j].decode() for i, j in zip(s[:-2], e[:-2], strict=True)] == kept and (e - s)[-2:].tolist() == [1, 1]


def test_rules_count_and_trees_are_monotone(spark):
    texts = [*corpus(23), "a a\nb\na a\nb\n\n" * 3, "# * x|y <z>\n" * 4, ("p q r s t u v w x y " * 6).strip()]
    x, y = np.random.default_rng(1).random((400, len(quality_rules.stats.NAMES))), np.arange(400) % 2
    forest = trees.fit(x, y.astype(float), {0: -1, 1: 1}, trees=20)
    got = {r.doc_id: r for r in quality_rules.score(frame(spark, texts), forest).collect()}
    for i, t in enumerate(texts):
        t = t or ""
        w = WORD.findall(t)
        at = defaultdict(list)
        for k in range(len(w) - 7):
            at[tuple(w[k : k + 8])].append(k)
        repeat = len({k + d for v in at.values() if len(v) > 1 for k in v for d in range(8)})
        lines = Counter(x for x in t.split("\n") if WORD.search(x))
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), sum(lines.values()) - len(lines), repeat), i
        assert r.base_failed == (len(w) < 20 or 100 * repeat > 30 * len(w)) and not (r.base_failed and r.kept)
    for feature, sign in ((0, -1), (1, 1)):
        grid = np.repeat(x[:50], 20, 0)
        grid[:, feature] = np.tile(np.linspace(-0.1, 1.1, 20), 50)
        assert (sign * np.diff(forest.margin(grid).reshape(50, 20), axis=1) >= -1e-12).all()


# --- nearest neighbours


def test_neighbours_by_brute_force(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(30, 16))
    x = centres[rng.integers(0, 30, 1500)] + 0.3 * rng.normal(size=(1500, 16))
    x[100:160] = x[100]  # copies: ties by vec_id
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(2000, None), (2050, [0.0] * 16), (2100, [float("nan")] * 16), (2150, [1.0] * 15 + [None]), (2200, [float("inf")] + [1.0] * 15), (None, [1.0] * 16)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = ann.search(df, df.where("vec_id % 50 = 0")).collect()
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    hit = 0
    for q in range(0, 1500, 50):
        s = unit @ unit[q]
        s[q] = -2
        mine = sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)
        assert [r.rank for r in mine] == [1, 2, 3, 4, 5]
        assert all(r.score == pytest.approx(s[r.vec_id]) for r in mine)
        hit += sum(r.score >= np.sort(s)[-5] - 1e-12 for r in mine)
    assert {r.query_id for r in got} == set(range(0, 1500, 50)) and hit >= 0.9 * 150
    assert [r.vec_id for r in sorted((r for r in got if r.query_id == 100), key=lambda r: r.rank)] == [101, 102, 103, 104, 105]
    empty = df.where("vec_id < 0")
    assert ann.search(empty, empty).count() == 0 and ann.search(df.where("vec_id in (0, 7)"), df.where("vec_id = 0")).count() == 1


def test_neighbours_of_each_dimension_and_of_repeated_ids(spark):
    rng = np.random.default_rng(8)
    rows = [(1, [1.0, 0.0]), (50, [1.0, 0.0, 0.0]), (51, [0.9, 0.1, 0.0]), (2, [0.8, 0.2]), (3, [0.0, 1.0])]
    rows += [(7, [0.0, 0.0, 1.0])] * 3 + [(7, [0.0, 1.0, 0.0]), (8, [0.1, 0.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = defaultdict(list)
    for r in sorted(ann.search(df, df).collect(), key=lambda r: r.rank):
        got[r.query_id].append(r.vec_id)
    assert got == {1: [2, 3], 2: [1, 3], 3: [2, 1], 50: [51, 8, 7], 51: [50, 7, 8], 7: [8, 51, 50], 8: [7, 50, 51]}
    x = rng.normal(size=(400, 8))
    ids = np.arange(400) // 2  # each id has two vectors
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<double>")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    best = (u @ u.T).reshape(200, 2, 200, 2).max((1, 3))
    np.fill_diagonal(best, -2)
    for r in ann.search(df, df.where("vec_id % 20 = 0")).collect():
        assert r.score == pytest.approx(best[r.query_id, r.vec_id]) and r.vec_id == np.argsort(-best[r.query_id])[r.rank - 1]


@tables
@pytest.mark.parametrize("sf", ["0.001", "0.01", "0.1"])
def test_recall_on_the_tables(spark, sf):
    path = SF.replace("0.001", sf)
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{path}/embeddings.parquet").select("vec_id", "embedding").collect()]
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], dtype=float)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    got = defaultdict(list)
    for r in QUERIES["op9_nearest_neighbours"](spark, path).collect():
        got[r.query_id].append(r.score)
    hit = 0
    for q in np.flatnonzero(ids % 50 == 0):
        s = np.delete(u @ u[q], q)
        hit += sum(g >= np.sort(s)[-5] - 1e-12 for g in got[ids[q]])
    assert hit >= 0.9 * 5 * len(got) and set(got) == set(ids[ids % 50 == 0].tolist())
    print(f"recall at sf{sf}: {hit / (5 * len(got)):.4f}")


@pytest.mark.parametrize("spread", [0.0, 0.05])
def test_neighbours_beside_a_hot_group(spark, spread):
    """A third of the rows are copies, or one tight cluster: no other query loses a neighbour."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(3000, 64))
    x[::3] = x[0] + spread * rng.normal(size=(1000, 64))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = defaultdict(list)
    for r in ann.search(df, df.where("vec_id % 50 = 1")).collect():
        got[r.query_id].append(r.score)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    for q in range(1, 3000, 50):
        assert sorted(got[q]) == pytest.approx(np.sort(np.delete(unit @ unit[q], q))[-5:])


# --- packing


def pieces_of(rows, texts, cap=2048):
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    ids = [np.array([*tok.encode(t or "", add_special_tokens=False).ids, 1], dtype="<u4") for t in texts]
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        assert r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes()) and r.doc_tokens == len(ids[r.doc_id])
        by_doc[r.doc_id].append((r.start, r.length))
        by_sequence[r.sequence_id].append((r.offset, r.length))
    for doc, found in by_doc.items():
        assert sum(n for _, n in found) == len(ids[doc]) and all(a + n == b for (a, n), (b, _) in zip(sorted(found), sorted(found)[1:], strict=False))
    padding = 0
    for found in by_sequence.values():
        found.sort()
        end = sum(n for _, n in found)
        assert found[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(found, found[1:], strict=False)) and end <= cap
        padding += 0 if end & (end - 1) == 0 else cap - end
    return by_doc, by_sequence, padding


def test_packing_round_trip(spark):
    texts = corpus(29)
    by_doc, _, padding = pieces_of(packing.pack(frame(spark, texts)).collect(), texts)
    assert set(by_doc) == set(range(len(texts))) and padding == 0


def test_packing_knows_added_tokens(spark):
    mark = "<|endoftext|>"
    texts = [f"hello {mark} world", mark, mark * 3, f"a  {mark}\n\n b{mark}c ", "<|endoftext |> <|endoftext|", f"  {mark}  ", "x"]
    assert packing.encode(texts[0].encode(), "byte_bpe_50k").tolist() == [31373, 220, 50256, 995, packing.END_ID]
    by_doc, _, _ = pieces_of(packing.pack(frame(spark, texts)).collect(), texts)
    assert set(by_doc) == set(range(len(texts)))


def test_packing_keeps_every_limit(spark):
    texts = corpus(31)
    docs = frame(spark, texts).withColumn("prompt", F.lit(5).cast("long"))
    limits = packing.Limits(tokens=2048, segments=3, loss=900)
    rows = packing.pack(docs, limits=limits, loss_from="prompt").collect()
    by_doc, _, _ = pieces_of(rows, texts)
    assert set(by_doc) == set(range(len(texts)))
    segments, loss = Counter(r.sequence_id for r in rows), Counter()
    for r in rows:
        assert r.loss_tokens == max(0, r.start + r.length - max(r.start, 5))
        loss[r.sequence_id] += r.loss_tokens
    assert max(segments.values()) <= 3 and max(loss.values()) <= 900


# --- all operators


@tables
@pytest.mark.parametrize("name", sorted(SQL))
def test_queries_match_sql(spark, name):
    import duckdb

    c = duckdb.connect()
    for t in ("documents", "embeddings", "labels"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = c.execute(SQL[name])
    cols = sorted(d[0] for d in want.description)
    order = [[d[0] for d in want.description].index(k) for k in cols]
    expected = sorted(repr([r[i] for i in order]) for r in want.fetchall())
    df = QUERIES[name](spark, SF)
    assert sorted(df.columns) == cols
    assert sorted(repr([r[k] for k in cols]) for r in df.collect()) == expected


def odd(spark, kind):
    if kind == "empty":
        return spark.createDataFrame([], SCHEMA)
    if kind == "nulls":
        return spark.createDataFrame([(None, None, None, None, None)] * 3 + [(None, "one two three four", None, None, None)] * 2 + [(7, None, None, None, None)], SCHEMA)
    if kind == "long":  # one very long text, and columns whose names operators use
        rng = random.Random(2)
        texts = [" ".join(prose(rng, 150_000, 20_000)), "short", ""]
        return frame(spark, texts).withColumn("node", F.lit(1)).withColumn("label", F.lit("x")).withColumn("score", F.lit(2)).withColumn("t", F.lit("t")).withColumn("block", F.lit(3))
    same = "the same words again and again in each of many rows " * 4
    return spark.createDataFrame([(1, same, "en", "src1", 1)] * 4 + [(2, same, "en", "src1", 1)] * 3, SCHEMA)


OPERATORS = {
    "op1": jaccard.join, "op2": lm_score.score, "op3": sharding.shard, "op5": substring.dedup, "op10": lambda d: packing.pack(d).where("start = 0"),
    "op6": lambda d: quality_fm.score(d, quality_fm.fit(d, d.selectExpr("doc_id", "1 AS quality"))),
    "op7": lambda d: quality_rules.score(d, quality_rules.fit(d, d.selectExpr("doc_id", "1 AS quality"))),
    "op8": lambda d: toxicity.score(d, toxicity.fit(d, d.selectExpr("doc_id", "1 AS toxic"))),
}


@pytest.mark.parametrize("kind", ["empty", "nulls", "repeated", "long"])
@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_a_result_for_each_row(spark, name, kind):
    docs = odd(spark, kind)
    assert sorted(map(repr, (r.doc_id for r in OPERATORS[name](docs).collect()))) == sorted(map(repr, (r.doc_id for r in docs.collect())))


@pytest.mark.parametrize("kind", ["empty", "nulls", "repeated", "long"])
def test_mixing_on_odd_tables(spark, kind):
    """No token beyond the budget, none from a row that isn't there; an empty table gives no rows."""
    docs = odd(spark, kind)
    there = sum(len(WORD.findall(r.text or "")) for r in docs.collect())
    rows = mixing.choose(docs).collect()
    ids = {r.doc_id for r in docs.collect()}
    assert sum(r.n_tokens for r in rows) <= there * mixing.Tree().percent // 100 and {r.doc_id for r in rows} <= ids
    assert mixing.mix(docs).columns == docs.columns and (kind != "empty" or not rows)


@tables
@pytest.mark.parametrize("kind", ["empty", "nulls", "repeated"])
def test_stages_on_odd_tables(spark, kind):
    import corpus_pipeline

    docs = odd(spark, kind).withColumn("node", F.lit(1)).withColumn("score", F.lit("s"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        assert out.count() <= 2 * docs.count(), name
    corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()


@tables
def test_pipeline(spark):
    """Each stage takes effect on what its predecessor kept."""
    import corpus_pipeline

    docs, seen = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs.collect()
        docs = spark.createDataFrame(stage(spark, docs, SF).collect(), docs.schema)
        after = docs.collect()
        seen.append(name)
        if name == "near_copies":
            order = sorted(before, key=lambda r: r.doc_id)
            root = classes([r.text for r in order], 5, 100, 80)
            assert {r.doc_id for r in after} == {order[i].doc_id for i in root if root[i][1] == i}
        if name == "substring_dedup":
            order = sorted(before, key=lambda r: r.doc_id)
            want = {r.doc_id: s for r, s in zip(order, stripped([r.text for r in order]), strict=True)}
            assert {r.doc_id: len(WORD.findall(r.text or "")) for r in after} == {k: n - gone for k, (n, gone, _) in want.items() if n == 0 or gone < n}
    assert seen == ["toxicity", "near_copies", "substring_dedup", "mixing"]
    packed = corpus_pipeline.run(spark, SF).collect()
    assert sum(r.length for r in packed) == sum(r.doc_tokens for r in packed if r.start == 0)
    assert {r.doc_id for r in packed} == {r.doc_id for r in docs.collect()}


def test_digest_of_kept_words(spark):
    docs = frame(spark, ["a b", None])
    rows = substring.dedup(docs).select("doc_id", F.sha2("kept", 256).alias("h")).collect()
    assert {r.doc_id: r.h for r in rows} == {0: hashlib.sha256(b"a b").hexdigest(), 1: hashlib.sha256(b"").hexdigest()}
