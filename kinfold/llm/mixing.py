"""Mixing sources to target weights by hierarchical budgets.

A tree of domains, languages and sources carries integer weights.  A node hands its token budget to
its children by weight; a child can take at most what its leaves hold times the allowed epochs, and
what it can't take goes to its siblings first (to other branches only when the whole node is full).
With capacities c and weights w, children get min(c, floor(l * w)) for the l = max over j of
(B - c_1 - ... - c_j) / (w_j+1 + ... + w_n), children in the order of c / w: water filling in closed form.

Each leaf then gives whole epochs, and of the last one a prefix in its seeded order: the documents
whose running sum of tokens (words of the whole text) stays within the rest.  The prefix ends at a
hash, found in one bucket of the leaf, so texts aren't shuffled and a leaf with a third of all rows
is many small sums.

Null text has no tokens; null language or source counts as ''.  Rows with equal ids stand or fall
together.  An empty table gives no rows, a corpus without tokens none of its rows but those of no
tokens; other columns don't matter.  Shares are rounded down.  Leaves are configuration-sized (at most MAX_LEAVES, checked) and known to the driver.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinfold.llm import ranks
from kinfold.llm.store import Scratch

MAX_LEAVES = 100_000
SEED = "mix-1"


@dataclass(frozen=True)
class Tree:
    """Domains are (name, weight, pattern of the source), the first that matches counts; the last takes all."""

    domains: tuple = (("core", 50, "^src[0-4]$"), ("web", 30, "^src([5-9]|1[0-4])$"), ("tail", 20, ""))
    langs: dict = field(default_factory=lambda: {"en": 55, "de": 15, "fr": 15, "es": 15})
    other_lang: int = 5
    sources: dict = field(default_factory=dict)
    other_source: int = 1
    #: Tokens of the mixture as a percentage of the tokens that are there.
    percent: int = 80
    epochs: int = 2


def fill(budget: int, weights: list[int], caps: list[int]) -> list[int]:
    """Shares of a budget among children: by weight, at most the capacity, shortages to siblings."""
    if budget >= sum(caps):
        return list(caps)
    order = sorted(range(len(caps)), key=lambda i: caps[i] / weights[i])
    taken, rest, level = 0, sum(weights), 0.0
    for i in order:
        level = max(level, (budget - taken) / rest)
        taken, rest = taken + caps[i], rest - weights[i]
    return [min(c, int(level * w)) for c, w in zip(caps, weights, strict=True)]


def budgets(leaves: dict[tuple, int], tree: Tree) -> dict[tuple, int]:
    """Token budget of each (domain, lang, source) from the tokens there."""
    cap = {k: n * tree.epochs for k, n in leaves.items()}
    weight = [
        {name: w for name, w, _ in tree.domains}.__getitem__,
        lambda lang: tree.langs.get(lang, tree.other_lang),
        lambda source: tree.sources.get(source, tree.other_source),
    ]
    given = {(): sum(leaves.values()) * tree.percent // 100}
    for level in range(3):
        nodes: dict[tuple, dict] = {}
        for k, c in cap.items():
            child = nodes.setdefault(k[:level], {})
            child[k[level]] = child.get(k[level], 0) + c
        given = {(*p, name): share for p, own in nodes.items() for name, share in zip(own, fill(given[p], [weight[level](c) for c in own], list(own.values())), strict=True)}
    return given


def _described(docs: DataFrame, tree: Tree):
    domain = F.lit(tree.domains[-1][0])
    source = F.coalesce(F.col("source").cast("string"), F.lit(""))
    for name, _, pattern in reversed(tree.domains[:-1]):
        domain = F.when(source.rlike(pattern), name).otherwise(domain)
    lang = F.coalesce(F.col("lang").cast("string"), F.lit(""))
    tokens = F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
    return {"domain": domain, "lang": lang, "source": source, "n_tokens": tokens}


def plan(docs: DataFrame, tree: Tree, seed: str = SEED) -> tuple[DataFrame, DataFrame]:
    """A row for each document (doc_id, leaf, n_tokens; written once), and one for each leaf with a
    share: whole epochs, and the hash at which the prefix of the last epoch ends ('' for none)."""
    spark = docs.sparkSession
    scratch, leaf = Scratch(spark, "mix"), ["domain", "lang", "source"]
    rows = scratch.write(docs.select(F.col("doc_id").cast("long").alias("doc_id"), *(c.alias(n) for n, c in _described(docs, tree).items())))
    totals = rows.groupBy(*leaf).agg(F.sum("n_tokens").alias("n"), F.count("*").alias("rows")).limit(MAX_LEAVES + 1).collect()
    if len(totals) > MAX_LEAVES:
        raise ValueError(f"more than {MAX_LEAVES} leaves")
    tokens = {(r.domain, r.lang, r.source): r.n for r in totals}
    given = budgets(tokens, tree)
    k = ranks.digits(max((r.rows for r in totals), default=0))
    parts = [(*key, given[key] // n, given[key] % n) for key, n in tokens.items() if n and given[key]]
    shares = spark.createDataFrame(parts, "domain string, lang string, source string, whole long, rest long")
    open_ = rows.join(F.broadcast(shares.where("rest > 0")), leaf).withColumn("h", ranks.shuffled(seed, F.col("whole"), F.col("doc_id"))).withColumn("b", F.substring("h", 1, k))
    sums = open_.groupBy(*leaf, "rest", "b").agg(F.sum("n_tokens").alias("s"))
    upto = Window.partitionBy(*leaf).orderBy("b").rowsBetween(Window.unboundedPreceding, 0)
    at = sums.withColumn("cum", F.sum("s").over(upto)).where("cum > rest and cum - s <= rest").select(*leaf, "b", (F.col("cum") - F.col("s")).alias("before"))
    ends = at.collect()  # a row for each leaf at most
    at = spark.createDataFrame(ends, "domain string, lang string, source string, b string, before long")
    run = Window.partitionBy(*leaf).orderBy("h").rangeBetween(Window.unboundedPreceding, 0)
    last = (
        open_.join(F.broadcast(at), [*leaf, "b"]).withColumn("cum", F.col("before") + F.sum("n_tokens").over(run))
        .where("cum <= rest").groupBy(*leaf).agg(F.max("h").alias("h")).collect()
    )
    until = {(r.domain, r.lang, r.source): r.b for r in ends} | {(r.domain, r.lang, r.source): r.h for r in last}
    return rows, spark.createDataFrame([(*p[:4], until.get(p[:3], "")) for p in parts], "domain string, lang string, source string, whole long, until string")


def _drawn(rows: DataFrame, shares: DataFrame, seed: str) -> DataFrame:
    """Rows (with leaf columns) once for each epoch that takes them, with ``epoch``."""
    joined = rows.join(F.broadcast(shares), ["domain", "lang", "source"])
    joined = joined.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("whole").cast("int"))))
    return joined.where((F.col("epoch") < F.col("whole")) | (ranks.shuffled(seed, F.col("epoch"), F.col("doc_id")) <= F.col("until")))


def choose(docs: DataFrame, tree: Tree | None = None, *, seed: str = SEED) -> DataFrame:
    """doc_id, domain, lang, source, epoch, n_tokens of the mixture; a document once for each epoch."""
    rows, shares = plan(docs, tree or Tree(), seed)
    return _drawn(rows, shares, seed).select("doc_id", "domain", "lang", "source", "epoch", "n_tokens")


def mix(docs: DataFrame, tree: Tree | None = None, *, seed: str = SEED) -> DataFrame:
    """The documents of the mixture with the columns of ``docs``, once for each epoch that takes them.

    The leaf of each document is compared with the small table of shares; texts stay where they are.
    """
    tree = tree or Tree()
    _, shares = plan(docs, tree, seed)
    described = docs.select(F.struct(*docs.columns).alias("_row"), F.col("doc_id"), *(c.alias(n) for n, c in _described(docs, tree).items() if n != "n_tokens"))
    return _drawn(described, shares, seed).select("_row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return choose(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source"))


def _sql() -> str:
    tree = Tree()
    domain = " ".join(f"WHEN regexp_matches(coalesce(source, ''), '{p}') THEN '{n}'" for n, _, p in tree.domains[:-1])
    weights = {
        "domain": "CASE domain " + " ".join(f"WHEN '{n}' THEN {w}" for n, w, _ in tree.domains) + " END",
        "lang": "CASE lang " + " ".join(f"WHEN '{n}' THEN {w}" for n, w in tree.langs.items()) + f" ELSE {tree.other_lang} END",
        "source": str(tree.other_source),
    }
    out, up = "", ""
    for i, level in enumerate(weights):
        keys = ", ".join(list(weights)[: i + 1])
        part = f"PARTITION BY {up}" if up else ""
        parent = f"JOIN g{i - 1} USING ({up})" if up else f"CROSS JOIN (SELECT (sum(n) * {tree.percent}) // 100 AS g FROM leaf)"
        out += f"""
c{i} AS (SELECT {keys}, sum(n) * {tree.epochs} AS cap, max({weights[level]}) AS w FROM leaf GROUP BY {keys}),
o{i} AS (SELECT c{i}.*, g AS b,
    coalesce(sum(cap) OVER ({part} ORDER BY cap::DOUBLE / w, {level} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS taken,
    sum(w) OVER ({part} ORDER BY cap::DOUBLE / w, {level} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS remaining,
    sum(cap) OVER ({part}) AS room FROM c{i} {parent}),
g{i} AS (SELECT {keys}, CASE WHEN b >= room THEN cap ELSE least(cap, floor(max(greatest(0, (b - taken)::DOUBLE / remaining::DOUBLE)) OVER ({part}) * w)::BIGINT) END AS g FROM o{i}),"""
        up = keys
    return f"""
WITH d AS (SELECT doc_id, CASE {domain} ELSE '{tree.domains[-1][0]}' END AS domain, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS n_tokens FROM documents),
leaf AS (SELECT domain, lang, source, sum(n_tokens)::BIGINT AS n FROM d GROUP BY ALL),{out}
share AS (SELECT domain, lang, source, g // n AS whole, g % n AS rest FROM leaf JOIN g2 USING (domain, lang, source) WHERE n > 0 AND g > 0),
e AS (SELECT d.*, whole, rest, unnest(range(0, whole::BIGINT + 1))::INT AS epoch FROM d JOIN share USING (domain, lang, source)),
r AS (SELECT *, CASE WHEN epoch < whole THEN 0 ELSE sum(n_tokens) OVER (PARTITION BY domain, lang, source, epoch ORDER BY md5('{SEED}|' || epoch || '|' || doc_id) RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) END AS cum FROM e)
SELECT doc_id, domain, lang, source, epoch, n_tokens::BIGINT AS n_tokens FROM r WHERE epoch < whole OR (rest > 0 AND cum <= rest)
"""


SQL = _sql()
