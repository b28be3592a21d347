"""Quality rules by robust multivariate outliers.

Each document gets counts of words, symbols, repeated lines and repeated word
windows.  Two plain rules fail a document at once.  The others are judged by a
vector of transformed statistics: for each language and source a minimum
covariance determinant estimate (location and scatter of the three quarters of
the documents that lie closest together) gives a Mahalanobis distance, and a
document too far from its group is rejected.  Concentration steps go from three
robust starts; the one of least determinant goes on until it no longer falls.

Groups below ``min_group`` documents are pooled by language, then together; what
is still below that is judged by the estimate of all documents.  In a table with
fewer than ``min_group`` documents to judge the core is all of them, about their
plain mean: three quarters of so few would span the rest too narrowly.  By that
estimate no distance can exceed the number of documents.  To the group's scatter is
added only the counting noise of each statistic, which keeps groups with a
constant statistic regular: the variance that a share or mean over so many words
has by chance, as a mean of the group.  Lines are so few that a document's own
number of them counts.

DataFrame operations only.  The concentration steps are grouped sums and a
histogram of distances, so a group that holds a third of all rows is summed
before it is shuffled.  Sums are decimal: reruns agree.  Null text has no words
and fails the base rules; a null language or source is a value of its own.  Rows
are judged one by one: those that repeat a doc_id or have none stay rows of their
own.  Columns other than doc_id, text, lang and source are not read.  Texts of any
length are taken whole; a task holds one of them at a time, with its windows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from signalweave.llm.store import materialize, scratch

SPACE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 3

#: Share of a group that the estimate rests on.
CORE = 0.75
#: Concentration steps of every start, and the fall of the determinant that a further step of the best one must bring.
TRIED = 2
FALL = 0.001
MIN_GROUP = 50
#: Group of the documents whose own group and whose language are both too small; labels of groups are JSON, so none is called so.
REST = "rest"
#: Repeated lines come last: their noise is a document's own, so only the last entry of the factor differs by row.
FEATURES = ("x0", "x1", "x2", "x4", "x3")
NOISE = ("v0", "v1", "v2", "v4", "v3")
#: Median of the chi-squared distribution with five degrees of freedom, and its quantile at one in ten million.
CHI2_MEDIAN, CHI2_CUT = 4.3515, 41.7


def text_counts(docs: DataFrame, extra: tuple[str, ...] = (), text: str = "text") -> DataFrame:
    """n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words beside doc_id and ``extra``; no shuffle."""
    t = F.coalesce(F.col(text), F.lit(""))
    d = docs.select("doc_id", *extra, t.alias("t"), F.btrim(t, F.lit(SPACE)).alias("trimmed"))
    d = d.select(
        "doc_id",
        *extra,
        F.char_length(F.translate("t", SPACE, "")).cast("bigint").alias("word_chars"),
        (F.char_length("t") - F.char_length(F.translate("t", SYMBOLS, ""))).cast("bigint").alias("n_symbols"),
        F.when(F.col("trimmed") == "", F.array().cast("array<string>")).otherwise(F.split("trimmed", r"[\x20\x09-\x0D]+")).alias("words"),
        F.filter(F.split("t", "\n"), lambda x: F.btrim(x, F.lit(SPACE)) != "").alias("lines"),
    )
    n = F.size("words")
    grams = F.transform(F.sequence(F.lit(0), n - WINDOW), lambda i: F.xxhash64(F.get("words", i), F.get("words", i + 1), F.get("words", i + 2)))
    d = d.select(
        "doc_id",
        *extra,
        n.cast("bigint").alias("n_words"),
        "word_chars",
        "n_symbols",
        F.size("lines").cast("bigint").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"),
        F.when(n >= WINDOW, grams).otherwise(F.array().cast("array<bigint>")).alias("grams"),
    )
    # Only texts with a repeated window pay for the sort that finds where its copies stand.
    marked = F.sort_array(F.transform("grams", lambda g, i: F.struct(g.alias("g"), i.alias("i"))))
    d = d.withColumn("marked", F.when(F.size(F.array_distinct("grams")) < F.size("grams"), marked))
    again = F.expr("filter(marked, (m, k) -> (k > 0 AND marked[k - 1].g = m.g) OR (k < size(marked) - 1 AND get(marked, k + 1).g = m.g))")
    places = F.sort_array(F.transform(again, lambda m: m["i"]))
    d = d.withColumn("places", F.when(F.col("marked").isNotNull(), places))
    covered = F.expr(f"aggregate(places, struct(-{WINDOW} AS last, 0L AS n), (a, p) -> struct(p AS last, a.n + least({WINDOW}, p - a.last) AS n), a -> a.n)")
    return d.select("doc_id", *extra, "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", F.coalesce(covered, F.lit(0)).cast("bigint").alias("n_repeat_words"))


def statistics(counts: DataFrame) -> DataFrame:
    """Adds base_failed and the transformed statistics that the distances are taken of."""
    words = F.greatest(F.col("n_words"), F.lit(1))
    return counts.select(
        "*",
        ((F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))).alias("base_failed"),
        F.log1p(F.col("n_words").cast("double")).alias("x0"),
        F.log1p(F.col("word_chars") / words).alias("x1"),
        F.sqrt(F.col("n_symbols") / F.greatest(F.col("word_chars"), F.lit(1))).alias("x2"),
        F.sqrt(F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1))).alias("x3"),
        F.sqrt(F.col("n_repeat_words") / words).alias("x4"),
        # Counting noise: of log n, of a mean word length, and 1/4n of the root of a share; repeated words come six at once.
        (1 / words).alias("v0"),
        (0.25 / words).alias("v1"),
        (0.25 / F.greatest(F.col("word_chars"), F.lit(1))).alias("v2"),
        (0.25 / F.greatest(F.col("n_lines"), F.lit(1))).alias("v3"),
        (1.5 / words).alias("v4"),
    )


def _exact(x: Column) -> Column:
    return F.sum(x.cast("decimal(38,12)")).cast("double")


def _quantile_bin(bins: DataFrame, keys: list[str], share: float) -> DataFrame:
    """The first bin of each key up to which at least ``share`` of its rows lie; bins: (keys, bin, n)."""
    upto = F.sum("n").over(Window.partitionBy(*keys).orderBy("bin"))
    total = F.sum("n").over(Window.partitionBy(*keys))
    marked = bins.withColumn("upto", upto).withColumn("total", total)
    return marked.where(F.col("upto") >= F.col("total") * share).groupBy(*keys).agg(F.min("bin").alias("bin"))


def _group_medians(rows: DataFrame, of: list[Column]) -> DataFrame:
    """(g, m0..m4): medians to within half a bin of 1/256 of each expression."""
    step = 256.0
    long = rows.select("g", F.posexplode(F.array(*[F.round(c * step).cast("bigint") for c in of])).alias("j", "bin"))
    found = _quantile_bin(long.groupBy("g", "j", "bin").agg(F.count(F.lit(1)).alias("n")), ["g", "j"], 0.5)
    picks = [F.max(F.when(F.col("j") == j, F.col("bin") / step)).alias(f"m{j}") for j in range(len(of))]
    return found.groupBy("g").agg(*picks)


def _distance(p: int) -> Column:
    """Squared Mahalanobis distance by forward substitution with the group's Cholesky factor; the last diagonal entry is still squared and without noise."""
    y: list[str] = []
    for i in range(p):
        rest = "".join(f" - l{i}{j} * {y[j]}" for j in range(i))
        own = f"l{i}{i}" if i < p - 1 else f"sqrt(greatest(l{i}{i} + {NOISE[i]}, 1e-9D))"
        y.append(f"(({FEATURES[i]} - c{i}{rest}) / {own})")
    return F.expr(" + ".join(f"{v} * {v}" for v in y))


def _bin_of(d2: Column) -> Column:
    """Bins of equal ratio, 2 % wide."""
    return F.floor(F.log(F.greatest(d2, F.lit(1e-12))) / F.log(F.lit(1.02))).cast("bigint")


def _factor(got: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """(keys, c*, l**, det): Cholesky factor and determinant of the scatter e** plus noise w*, about the centres c*."""
    p = len(FEATURES)
    for j in range(p):
        # A column of the factor at a time: its diagonal, then what is below it.
        own = f"e{j}{j}" + (f" + w{j}" if j < p - 1 else "") + "".join(f" - l{j}{k} * l{j}{k}" for k in range(j))
        got = got.selectExpr("*", (f"sqrt(greatest({own}, 1e-9D))" if j < p - 1 else f"greatest({own}, 0D)") + f" AS l{j}{j}")
        if j < p - 1:
            got = got.selectExpr("*", *[f"(e{i}{j}" + "".join(f" - l{i}{k} * l{j}{k}" for k in range(j)) + f") / l{j}{j} AS l{i}{j}" for i in range(j + 1, p)])
    det = " * ".join([f"greatest(l{p - 1}{p - 1} + w{p - 1}, 1e-9D)", *[f"l{i}{i} * l{i}{i}" for i in range(p - 1)]])
    return got.selectExpr(*keys, *[f"c{i}" for i in range(p)], *[f"l{i}{j}" for i in range(p) for j in range(i + 1)], f"{det} AS det")


def _moments(rows: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """(keys, n, s*, q**): number of rows, sums and sums of products; exact, so they can be added up further."""
    p = len(FEATURES)
    exact = lambda x: f"sum(CAST({x} AS decimal(38,12)))"
    sums = ["count(1) AS n", *[f"{exact(f)} AS s{i}" for i, f in enumerate(FEATURES)]]
    sums += [f"{exact(f'{FEATURES[i]} * {FEATURES[j]}')} AS q{i}{j}" for i in range(p) for j in range(i + 1)]
    return rows.groupBy(*keys).agg(*[F.expr(x) for x in sums])


def _estimate(sums: DataFrame, noise: DataFrame) -> DataFrame:
    """(g, s, c*, l**, det): mean and factor of the covariance of each group and start, from its moments."""
    p = len(FEATURES)
    lower = [(i, j) for i in range(p) for j in range(i + 1)]
    means = sums.selectExpr("g", "s", *[f"CAST(s{i} AS double) / n AS c{i}" for i in range(p)], *[f"CAST(q{i}{j} AS double) / n AS q{i}{j}" for i, j in lower])
    scatter = means.selectExpr("g", "s", *[f"c{i}" for i in range(p)], *[f"q{i}{j} - c{i} * c{j} AS e{i}{j}" for i, j in lower])
    return _factor(scatter.join(noise, "g"), ("g", "s"))


def _starts(judged: DataFrame, noise: DataFrame) -> DataFrame:
    """(g, s, c*, l**, det): three robust first estimates of each group about its medians.

    Statistics are divided by their median deviations, widened by the noise.  The
    first scatter has these alone, the second is the mean product of hyperbolic
    tangents, the third that of directions (vectors of length one).
    """
    p = len(FEATURES)
    medians = materialize(_group_medians(judged, [F.col(f) for f in FEATURES]), "medians")
    centred = judged.join(medians, "g")
    spread = _group_medians(centred.select("g", *[F.abs(F.col(f) - F.col(f"m{i}")).alias(f"x{i}") for i, f in enumerate(FEATURES)]), [F.col(f) for f in FEATURES])
    spread = spread.withColumnsRenamed({f"m{i}": f"d{i}" for i in range(p)})
    wide = [F.sqrt((1.4826 * F.col(f"d{i}")) ** 2 + F.col(f"w{i}")).alias(f"d{i}") for i in range(p)]
    about = materialize(medians.join(spread, "g").join(noise, "g").select("g", *[f"m{i}" for i in range(p)], *wide, *[f"w{i}" for i in range(p)]), "about")
    z = judged.join(about, "g").select("g", *[((F.col(f) - F.col(f"m{i}")) / F.col(f"d{i}")).alias(f"z{i}") for i, f in enumerate(FEATURES)])
    length = F.greatest(F.sqrt(sum((F.col(f"z{i}") * F.col(f"z{i}") for i in range(p)), F.lit(0.0))), F.lit(1e-9))
    bent = z.select("g", *[F.tanh(f"z{i}").alias(f"t{i}") for i in range(p)], *[(F.col(f"z{i}") / length).alias(f"u{i}") for i in range(p)])
    products = bent.groupBy("g").agg(*[_exact(F.col(f"{x}{i}") * F.col(f"{x}{j}")).alias(f"{x}{i}{j}") for x in "tu" for i in range(p) for j in range(i + 1)])
    side = about.join(products, "g")
    found = None
    for s, x in enumerate(" tu"):
        # Only the shape counts: its trace is brought to the number of statistics.
        trace = F.greatest(sum((F.col(f"{x}{i}{i}") for i in range(p)), F.lit(0.0)), F.lit(1e-9)) if s else F.lit(1.0)
        shape = {(i, j): F.col(f"{x}{i}{j}") * p / trace if s else F.lit(float(i == j)) for i in range(p) for j in range(i + 1)}
        scatter = [(shape[i, j] * F.col(f"d{i}") * F.col(f"d{j}")).alias(f"e{i}{j}") for i in range(p) for j in range(i + 1)]
        one = _factor(side.select("g", F.lit(s).alias("s"), *[F.col(f"m{i}").alias(f"c{i}") for i in range(p)], *scatter, *[f"w{i}" for i in range(p)]), ("g", "s"))
        found = one if found is None else found.unionByName(one)
    return materialize(found, "starts")


def _concentrated(judged: DataFrame, model: DataFrame, noise: DataFrame, core: float) -> DataFrame:
    """The estimate of each group's ``core`` of rows nearest by ``model``, one for each start, with ``was``, the determinant before.

    One pass over the rows: moments are summed for each bin of distances, and the
    bins of the core are added up.
    """
    near = judged.join(model.drop("det"), "g").select("g", "s", *FEATURES, _bin_of(_distance(len(FEATURES))).alias("bin"))
    binned = _moments(near, ("g", "s", "bin"))
    ascending = Window.partitionBy("g", "s").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    total = F.sum("n").over(Window.partitionBy("g", "s"))
    # The bins up to the one with which the core is reached.
    inner = binned.withColumn("before", F.coalesce(F.sum("n").over(ascending), F.lit(0))).withColumn("total", total).where(F.col("before") < F.col("total") * core)
    summed = inner.groupBy("g", "s").agg(*[F.sum(c).alias(c) for c in binned.columns if c not in ("g", "s", "bin")])
    was = model.select("g", "s", F.col("det").alias("was"))
    return materialize(_estimate(summed, noise).join(was, ["g", "s"]), "model")


def least_determinant(judged: DataFrame, noise: DataFrame, core: float = CORE) -> DataFrame:
    """(g, c*, l**): for each group, of all estimates met on the way the one of least determinant.

    All starts take ``TRIED`` concentration steps; the best of each group goes on
    until its determinant falls by less than ``FALL``, so every further step
    shrinks it by that share and the steps end by themselves.
    """
    model = _starts(judged, noise)
    met = []
    for _ in range(TRIED):
        model = _concentrated(judged, model.drop("was"), noise, core)
        met.append(model)
    # Equal determinants are decided by the number of the start, so that reruns agree.
    model = model.groupBy("g").agg(F.min_by(F.struct(*[c for c in model.columns if c != "g"]), F.struct("det", "s")).alias("best")).select("g", "best.*")
    while not model.isEmpty():
        after = _concentrated(judged, model.drop("was"), noise, core)
        met.append(after)
        model = after.where(F.col("det") < F.col("was") * (1 - FALL))
    every = met[0].withColumn("step", F.lit(0))
    for k, m in enumerate(met[1:], 1):
        every = every.unionByName(m.withColumn("step", F.lit(k)))
    fields = [c for c in met[0].columns if c not in ("g", "s", "det", "was")]
    out = every.groupBy("g").agg(F.min_by(F.struct(*fields), F.struct("det", "s", "step")).alias("best")).select("g", "best.*")
    return materialize(out, "least")


def robust_groups(rows: DataFrame, min_group: int = MIN_GROUP) -> DataFrame:
    """Adds g: language and source, the pool of a language where that is too small, and ``rest`` where the pool is too."""
    label = F.to_json(F.struct("lang", "source"), {"ignoreNullFields": "false"})
    pool = F.to_json(F.struct("lang"), {"ignoreNullFields": "false"})
    judged = rows.where(~F.col("base_failed"))
    sizes = judged.groupBy(label.alias("label"), pool.alias("pool")).agg(F.count(F.lit(1)).alias("n"))
    small = F.when(F.col("n") < min_group, F.col("n")).otherwise(0)
    pools = sizes.groupBy("pool").agg(F.sum(small).alias("pooled"))
    g = F.when(F.col("n") >= min_group, F.col("label")).when(F.col("pooled") >= min_group, F.col("pool")).otherwise(F.lit(REST))
    groups = materialize(sizes.join(pools, "pool").select("label", g.alias("g")), "groups")
    return rows.withColumn("label", label).join(groups, "label", "left").drop("label")


def mcd_distances(rows: DataFrame, core: float = CORE, min_group: int = MIN_GROUP) -> DataFrame:
    """Adds distance2, scaled so that the core of each group has the median of a Gaussian.

    It is null for rows that the base rules fail.
    """
    judged = rows.where(~F.col("base_failed")).select("g", *FEATURES, *NOISE)
    sizes = judged.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("g") == REST, 1)).alias("rest")).first()
    if sizes["n"] < min_group:
        judged = judged.withColumn("g", F.lit(REST))
        noise = materialize(judged.groupBy("g").agg(*[(_exact(F.col(v)) / F.count(F.lit(1))).alias(f"w{i}") for i, v in enumerate(NOISE)]), "noise")
        plain = materialize(_estimate(_moments(judged.withColumn("s", F.lit(0)), ("g", "s")), noise).drop("g", "s", "det"), "plain")
        return rows.join(F.broadcast(plain), F.lit(True), "left").withColumn("distance2", F.when(~F.col("base_failed"), _distance(len(FEATURES)))).select(*rows.columns, "distance2")
    if 0 < sizes["rest"] < min_group:  # too few for an estimate of their own: that of all documents stands in
        judged = judged.where(F.col("g") != REST).unionByName(judged.withColumn("g", F.lit(REST)))
    p = len(FEATURES)
    noise = materialize(judged.groupBy("g").agg(*[(_exact(F.col(v)) / F.count(F.lit(1))).alias(f"w{i}") for i, v in enumerate(NOISE)]), "noise")
    with scratch() as keep:
        model = keep(least_determinant(judged, noise, core))
    near = judged.join(model, "g").select("g", _bin_of(_distance(p)).alias("bin"))
    middle = _quantile_bin(near.groupBy("g", "bin").agg(F.count(F.lit(1)).alias("n")), ["g"], 0.5)
    scale = F.pow(F.lit(1.02), F.col("bin") + 0.5) / F.lit(CHI2_MEDIAN)
    # A group tighter than the counting noise is not stretched to look Gaussian.
    scales = materialize(middle.select("g", F.greatest(scale, F.lit(1.0)).alias("scale")), "scales")
    model = model.join(scales, "g")
    return rows.join(model, "g", "left").withColumn("distance2", F.when(~F.col("base_failed"), _distance(p) / F.col("scale"))).select(*rows.columns, "distance2")


def quality_rules(docs: DataFrame, cut: float = CHI2_CUT, min_group: int = MIN_GROUP) -> DataFrame:
    """doc_id, the counts, base_failed, distance2 (null where not judged), kept."""
    rows = materialize(statistics(text_counts(docs, ("lang", "source"))), "statistics")
    judged = mcd_distances(robust_groups(rows, min_group), min_group=min_group)
    kept = ~F.col("base_failed") & F.coalesce(F.col("distance2") <= cut, F.lit(True))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "distance2", kept.alias("kept"))
