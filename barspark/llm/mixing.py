"""Mixing by soft domain membership, in DataFrame and SQL functions only.

A naive Bayes classifier over the telling words of the labelled documents gives
every document a posterior over domains.  Nonnegative document rates are then
fitted so that the expected tokens of each domain meet targets: projected gradient
steps on the least squares of the domains' relative errors.  Documents of nearly
one posterior share a rate: their tokens and their exact expected tokens by domain
are added up first, cell by cell, so that a step is one aggregation over cells,
whose number is bounded whatever the size of the corpus, and what a step weighs
is the documents' own mass and not a rounded one.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barspark.llm.common import Workspace

#: What separates words; A-Z are lowered first.
BREAK = r"[\s.,;:!?|\"'()\[\]*#&%$]+"


@dataclass(frozen=True)
class MixConfig:
    """``targets`` are shares of the token budget by domain; ``budget`` is its share of all tokens.

    Words are kept that are in at least ``support`` labelled documents and whose
    log share in one domain leads all others by ``telling`` over the root of their
    documents.  Words that point to no one domain stay out, as many weak ones of a
    text depend on one another.  Up to ``inline`` words are looked up in a constant
    set, more are joined.  At most ``labelled`` documents per domain are read.
    The iteration ends when no domain's expected share is off by more than
    ``close``, when the projected gradient, on average over tokens, is no longer
    than ``flat``, or after ``steps``.
    """

    targets: dict[str, float] = field(default_factory=lambda: {"good": 0.9, "poor": 0.1, "toxic": 0.0})
    budget: float = 0.9
    support: int = 5
    telling: float = 6.0
    inline: int = 20000
    labelled: int = 20000
    steps: int = 100
    close: float = 5e-4
    flat: float = 2e-5


@dataclass(frozen=True)
class Domains:
    """Words with their log-odds by domain, a table and how many rows it has, and log-priors."""

    words: DataFrame
    count: int
    prior: list[float]


def domain(quality: Column, toxic: Column) -> Column:
    """Domain of a labelled document; null where either label is missing."""
    return F.when(toxic == 1, "toxic").when(quality == 1, "good").when(quality == 0, "poor")


def _words(text: Column) -> Column:
    return F.split(F.lower(F.coalesce(text, F.lit(""))), BREAK)


def _traits(text: Column) -> Column:
    """Pseudo-words, none of which a text can hold, for a text's shape."""
    text = F.coalesce(text, F.lit(""))
    size = F.length(text)
    matched = lambda pattern, every: F.regexp_count(text, F.lit(pattern)) * every > size
    holds = lambda sign, every: (size - F.length(F.replace(text, F.lit(sign)))) * every > size
    shapes = {" capitals": matched("[A-Z]", 3), " marks": matched("[#*&%$]{2,}", 50), " shouts": holds("!!", 15), " bars": holds("|", 40), " short": size < 60}
    # no higher-order function, so that Spark compiles the tests; a text of no shape has an empty word
    return F.split(F.concat_ws(",", *(F.when(test, F.lit(name)) for name, test in shapes.items())), ",")


def _evidence(text: Column) -> Column:
    return F.concat(F.array_distinct(_words(text)), _traits(text))


def learn(documents: DataFrame, labels: DataFrame, names: list[str], config: MixConfig, work: Workspace) -> Domains:
    """Word log-likelihoods and log-priors by domain.

    Labelled documents are those with the smallest hashed ids.  A word counts
    once per document; likelihoods are smoothed document shares.  Contradicting
    labels of one id are settled by the smallest.
    """
    spark = documents.sparkSession
    nothing = Domains(spark.createDataFrame([], "word string, weight array<double>"), 0, [0.0] * len(names))
    named = labels.select(F.col("doc_id").cast("long").alias("id"), domain(F.col("quality"), F.col("toxic")).alias("domain"))
    named = named.where(F.col("domain").isin(names)).groupBy("id").agg(F.min("domain").alias("domain"))
    sizes = {r["domain"]: r["n"] for r in named.groupBy("domain").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return nothing
    # a share of each domain by hash first, so that no single task sees a whole domain
    share = F.coalesce(*(F.when(F.col("domain") == d, F.lit(min(1.0, 2 * config.labelled / n))) for d, n in sizes.items()))
    named = named.where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < share * (1 << 20))
    order = Window.partitionBy("domain").orderBy(F.xxhash64("id"), "id")
    named = named.withColumn("at", F.row_number().over(order)).where(F.col("at") <= config.labelled).drop("at")
    # at most ``labelled`` rows for each domain
    texts = documents.select(F.col("doc_id").cast("long").alias("id"), "text").join(F.broadcast(named), "id")
    seen = texts.select("domain", F.explode(_evidence(F.col("text"))).alias("word")).where("word <> ''")
    counts = seen.groupBy("word").agg(*(F.count_if(F.col("domain") == d).alias(f"n{i}") for i, d in enumerate(names)))
    totals = {r["domain"]: r["n"] for r in texts.groupBy("domain").agg(F.count("*").alias("n")).collect()}
    if not totals:
        return nothing
    size = [totals.get(d, 0) for d in names]
    logs = [F.log((F.col(f"n{i}") + 0.5) / (size[i] + 1.0)) for i in range(len(names))]
    support = sum((F.col(f"n{i}") for i in range(len(names))), F.lit(0))
    ranked = F.reverse(F.array_sort(F.array(*logs)))
    second = F.element_at(ranked, 2) if len(names) > 1 else F.element_at(ranked, 1)
    telling = (F.element_at(ranked, 1) - second) * F.sqrt(support.cast("double"))
    kept = counts.where((support >= config.support) & (telling >= config.telling))
    absences = [F.log1p(-(F.col(f"n{i}") + 0.5) / (size[i] + 1.0)) for i in range(len(names))]
    table = work.table("words", kept.select("word", F.array(*(a - b for a, b in zip(logs, absences))).alias("weight"), F.array(*absences).alias("absent")))
    whole = table.agg(F.count("*").alias("n"), *(F.coalesce(F.sum(F.element_at("absent", i + 1)), F.lit(0.0)).alias(f"a{i}") for i in range(len(names)))).first()
    prior = [math.log((n + 1) / (sum(size) + len(names))) + whole[f"a{i}"] for i, n in enumerate(size)]
    return Domains(table.select("word", "weight"), whole["n"], prior)


def posteriors(documents: DataFrame, model: Domains, names: list[str], config: MixConfig, work: Workspace) -> DataFrame:
    """doc_id, n_tokens (words of the whole text), ``posterior`` by domain and ``cell`` of every distinct doc_id.

    Texts are read once; what goes on is a document's length and its known
    words.  A document of no known word has the posterior of their absence.
    A cell is the whole percents of a posterior, and of memberships below one
    percent the half power of two.
    """
    split = documents.select(F.col("doc_id").cast("long").alias("doc_id"), _words(F.col("text")).alias("words"), _traits(F.col("text")).alias("traits"))
    edges = (F.element_at("words", 1) == "").cast("int") + ((F.size("words") > 1) & (F.element_at("words", -1) == "")).cast("int")
    both = F.concat("words", "traits")
    weights = model.words
    if model.count <= config.inline:
        rows = weights.collect()
        known = [r.word for r in rows]
        both = F.filter(both, lambda w: w.isin(known) if known else F.lit(False))
        weights = F.broadcast(documents.sparkSession.createDataFrame(rows, weights.schema))  # at most ``inline`` rows
    read = split.select("doc_id", (F.size("words") - edges).cast("long").alias("n_tokens"), F.array_distinct(both).alias("known"))
    read = work.table("read", read)
    pairs = read.select("doc_id", F.explode("known").alias("word")).distinct().join(weights, "word")
    scores = pairs.groupBy("doc_id").agg(*(F.sum(F.element_at("weight", i + 1)).alias(f"s{i}") for i in range(len(names))))
    tokens = read.groupBy("doc_id").agg(F.max("n_tokens").alias("n_tokens"))
    logits = [F.coalesce(f"s{i}", F.lit(0.0)) + F.lit(float(model.prior[i])) for i in range(len(names))]
    joined = tokens.join(scores, tokens.doc_id.eqNullSafe(scores.doc_id), "left").select(tokens.doc_id, "n_tokens", F.array(*logits).alias("logit"))
    odds = F.transform("logit", lambda x: F.exp(x - F.array_max("logit")))
    joined = joined.withColumn("odds", odds).withColumn("total", F.aggregate("odds", F.lit(0.0), lambda a, b: a + b))
    # the sums of a text's weights come in any order: twelve digits are the same in every run
    joined = joined.withColumn("posterior", F.transform("odds", lambda x: F.round(x / F.col("total"), 12)))
    cell = F.transform("posterior", lambda x: F.when(x >= 0.01, F.floor(100 * x)).otherwise(F.floor(F.greatest(2 * F.log2(x), F.lit(SMALLEST)))).cast("int"))
    return joined.select("doc_id", "n_tokens", "posterior", F.coalesce(cell, F.array()).alias("cell"))


#: Half powers of two below which memberships share a cell.
SMALLEST = -60.0

#: Steps that are compiled into one expression before the rates are written.
NESTED = 30


def _stepped(pulls: list[list[float]]) -> Column:
    """Projected gradient steps in turn, from column ``rate``, as one expression of plain arithmetic, which Spark compiles."""
    rate = "rate"
    for pull in pulls:
        drop = " + ".join(f"mean[{i}] * {float(x)!r}D" for i, x in enumerate(pull))
        rate = f"greatest(0D, {rate} - ({drop}))"
    return F.expr(rate)


@dataclass(frozen=True)
class Fit:
    """Rates by cell, the expected domain shares that they reach, the last projected gradient and the steps taken."""

    rates: DataFrame
    shares: list[float]
    flat: float
    steps: int


def _solved(rows: list[list[float]], values: list[float]) -> list[float]:
    """Solution of a small system of equations, by elimination with pivots; a few domains, on the driver."""
    table = [[*row, value] for row, value in zip(rows, values)]
    n = len(table)
    for i in range(n):
        pivot = max(range(i, n), key=lambda k: abs(table[k][i]))
        table[i], table[pivot] = table[pivot], table[i]
        for k in range(n):
            if k != i and table[i][i]:
                share = table[k][i] / table[i][i]
                table[k] = [x - share * y for x, y in zip(table[k], table[i])]
    return [row[-1] / row[i] if row[i] else 0.0 for i, row in enumerate(table)]


def fit_rates(members: DataFrame, names: list[str], config: MixConfig, work: Workspace) -> Fit:
    """Rate of every cell of ``members(n_tokens, posterior, cell)``.

    Rates minimise sum((expected - target)**2 / size) over domains, in shares of
    all tokens, from rate 1, by gradient steps projected on rates of zero and
    more.  A step's pull on each domain comes from the gradient and the curvature
    among the documents that still have a rate: their overlaps by domain, which
    the last step's aggregation gives too.  A step that does not lower the error
    is halved.  Domains without tokens are left out.  ``mean`` is a cell's
    expected tokens by domain over its tokens, not the middle of the cell.
    """
    i_ = range(len(names))
    p = [F.element_at("mean", i + 1) for i in i_]
    n, rate = F.col("n_tokens"), F.col("rate")
    own = [F.element_at("posterior", i + 1) for i in i_]
    mean = F.array(*(F.when(F.sum("n_tokens") > 0, F.sum(F.col("n_tokens") * own[i]) / F.sum("n_tokens")).otherwise(F.avg(own[i])) for i in i_))
    groups = members.groupBy("cell").agg(F.sum("n_tokens").cast("double").alias("n_tokens"), mean.alias("mean"))
    groups = work.table("rates-0", groups.withColumn("rate", F.lit(1.0)))
    first = groups.agg(F.sum(n).alias("all"), *(F.sum(n * p[i]).alias(f"d{i}") for i in i_)).first()
    if not first["all"]:
        return Fit(groups, [0.0] * len(names), 0.0, 0)
    size = [first[f"d{i}"] / first["all"] for i in i_]
    live = [s > 1e-9 for s in size]
    target = [config.targets.get(d, 0.0) * config.budget for d in names]
    pulls: list[list[float]] = []  # not yet written

    def measured(steps: list[list[float]]) -> tuple[list[float], list[list[float]], float, list[float]]:
        """Expected shares, overlaps of documents with a rate, error and distance from the targets."""
        rows = groups.select("n_tokens", "mean", _stepped(steps).alias("rate")) if steps else groups
        inside = F.when(rate > 0, n).otherwise(0.0)
        sums = rows.agg(*(F.sum(n * rate * p[i]).alias(f"d{i}") for i in i_), *(F.sum(inside * p[i] * p[j]).alias(f"o{i}_{j}") for i in i_ for j in range(i, len(names)))).first()
        shares = [sums[f"d{i}"] / first["all"] for i in i_]
        overlap = [[sums[f"o{min(i, j)}_{max(i, j)}"] / first["all"] for j in i_] for i in i_]
        off = [shares[i] - target[i] if live[i] else 0.0 for i in i_]
        return shares, overlap, sum(off[i] ** 2 / size[i] for i in i_ if live[i]), off

    def slope(steps: list[list[float]], off: list[float]) -> float:
        """Mean change of rates by a unit step along the projected gradient: zero at the optimum."""
        rows = groups.select("n_tokens", "mean", _stepped(steps).alias("rate")) if steps else groups
        down = rate - sum((p[i] * (off[i] / size[i]) for i in i_ if live[i]), F.lit(0.0))
        return rows.agg(F.sum(n * F.abs(rate - F.greatest(F.lit(0.0), down)))).first()[0] / first["all"]

    shares, overlap, error, off = measured([])
    done, flat = 0, math.inf
    while max(map(abs, off)) > config.close and done < config.steps:
        # a thousandth of each size keeps a domain that hardly anything holds from pulling without end
        pull = _solved([[overlap[i][j] + (1e-3 * size[i] if i == j else 0.0) if live[i] and live[j] else float(i == j) for j in i_] for i in i_], off)
        for _ in range(12):
            done += 1
            tried = measured([*pulls, pull])
            if tried[2] < error:
                break
            pull = [x / 2 for x in pull]
        else:
            break
        gained = error - tried[2]
        pulls.append(pull)
        shares, overlap, error, off = tried
        if len(pulls) == NESTED:
            groups, pulls = work.table(f"rates-{done}", groups.withColumn("rate", _stepped(pulls))), []
        if gained < 0.01 * (error + gained) and (flat := slope(pulls, off)) <= config.flat:
            break
    if flat == math.inf:
        flat = slope(pulls, off)
    return Fit(groups.withColumn("rate", _stepped(pulls)) if pulls else groups, shares, flat, done)


def mix(documents: DataFrame, labels: DataFrame, config: MixConfig = MixConfig()) -> DataFrame:
    """Domain posteriors and rate of every document.

    Returns one row per distinct doc_id: doc_id, n_tokens, domain (of the
    largest posterior), posterior (array in the sorted order of the targets'
    names), rate.  A rate is the expected number of copies of a document.

    Null texts have no tokens and the posterior of a document without known
    words; a null doc_id is one document.  Repeated rows of an id are one
    document with its longest text's length.  Without any labels all domains
    are equally likely; with so few that no word has enough support every document
    has the prior, and so one rate.  An empty table gives no rows.
    """
    names = sorted(config.targets)
    work = Workspace(documents.sparkSession, "mix")
    members = work.table("members", posteriors(documents, learn(documents, labels, names, config, work), names, config, work))
    rates = work.table("rates", fit_rates(members, names, config, work).rates.select(F.col("cell").alias("of"), "rate"))
    # a row for each cell, some ten thousand at most for three domains; more are joined
    rates = F.broadcast(rates) if rates.count() <= MOST_RATES else rates
    best = F.element_at(F.array(*map(F.lit, names)), F.array_position("posterior", F.array_max("posterior")).cast("int"))
    joined = members.join(rates, F.col("cell") == F.col("of"))
    return joined.select("doc_id", "n_tokens", best.alias("domain"), "posterior", "rate")


#: Cells whose rates may be broadcast.
MOST_RATES = 200_000


def apply_rates(documents: DataFrame, mixed: DataFrame) -> DataFrame:
    """Documents repeated as their rates say, with all their columns.

    A document appears floor(rate) times and once more if its hashed id falls
    below the rest, so that a domain's expected tokens are those of the fit; only
    a rate of zero drops every document.  Rows without a doc_id stay.
    """
    chance = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    copies = F.floor("rate") + (chance < F.col("rate") - F.floor("rate")).cast("int")
    rates = mixed.where("doc_id is not null").select(F.col("doc_id").alias("mixed_id"), copies.cast("int").alias("copies"))
    joined = documents.join(rates, documents["doc_id"] == rates["mixed_id"], "left")
    times = F.coalesce(rates["copies"], F.lit(1))
    row = F.struct(*(documents[c] for c in documents.columns)).alias("row")
    return joined.where(times > 0).select(row, F.explode(F.sequence(F.lit(1), times))).select("row.*")
