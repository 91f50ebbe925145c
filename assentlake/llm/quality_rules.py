"""Quality rules, and robust outliers by minimum covariance determinant, in DataFrame operations.

Each document becomes a vector of five transformed statistics. For each language and source the
centre and covariance of the most compact three quarters of the vectors are found by
concentration steps: keep the nearest vectors, estimate from them, measure all distances anew,
repeat until the determinant falls no more; of several starts the least determinant counts. A
small group leans on the spreads of all groups together. A document far from the centre in the Mahalanobis
distance of its group is rejected. Groups meet in partial sums and in histograms of bounded
length only; limits and estimates, a row for each group, are written before rows meet them, so
that their real size decides: as long as they can be broadcast, no row moves to its group. Beyond
that the join is dealt by group, and adaptive execution splits a large one.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from assentlake.session import staged

SPACES = r"[ \t-\r]+"
SYMBOLS = "#*$%&|<>"
LEAST_WORDS, MOST_REPEATED = 50, 50

FEATURES = ("f0", "f1", "f2", "f3", "f4")
#: Added to the spread of each feature, so that one without any spread can be inverted: log words,
#: log word length, symbols, repeated words, lines.
FLOORS = (0.01, 0.01, 0.01, 0.01, 0.01)
#: The error with which a row of n words or characters shows a rate near zero, as variances: half
#: a root of the n over the size of a clump. A repeat is at least six words, a line stands alone.
#: Most groups have no symbols and no repeats at all, and no spread to measure them by.
VARIANCES = ("v2", "v3", "v4")
#: Weight of the covariance pooled over all groups against the rows of a group, in rows.
PRIOR_ROWS = 20.0
#: Share of a group that the estimates rest on, the steps that every start takes, and the fall of
#: the logarithm of the determinant below which a group has settled.
COMPACT, FIRST_STEPS, SETTLED = 0.75, 2, 0.01
#: Starts: medians with own spreads, medians with the spreads of all groups, mean and covariance.
STARTS = 3
#: Median of the chi-squared distribution with five degrees of freedom, and the squared distance beyond
#: which a vector is an outlier: its quantile at one minus 1e-5.
CHI_MEDIAN, CHI_LIMIT = 4.3515, 30.86
#: Bins for a unit of a value, and from ``LINEAR`` on for each doubling of it.
BINS, LINEAR = 256, 32
CELLS = [(i, j) for i in range(5) for j in range(i + 1)]
#: The columns of an estimate: centre and inverse factor.
PLACES = [f"m{i}" for i in range(5)] + [f"w{i}{j}" for i, j in CELLS]


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words.

    Words are runs of anything but ASCII white space; a null text has none.
    """
    text = F.coalesce("text", F.lit(""))
    base = docs.select(F.col("doc_id").cast("long"), "lang", "source", text.alias("text")).select(
        "doc_id",
        "lang",
        "source",
        F.filter(F.split("text", SPACES, -1), lambda x: x != "").alias("words"),
        F.filter(F.split("text", "\n", -1), lambda x: x.rlike(r"[^ \t-\r]")).alias("lines"),
        F.length(F.regexp_replace("text", SPACES, "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
    )
    w = F.col("words")
    # The windows of three words by their hash, with their places; equal ones become neighbours.
    windows = F.when(
        F.size(w) >= 3,
        F.sort_array(
            F.transform(
                F.sequence(F.lit(0), F.size(w) - 3),
                lambda i: F.struct(F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("i")),
            )
        ),
    )
    v = F.col("windows")

    def same(x: Column, other: Column) -> Column:
        return F.coalesce(F.get(v, other)["h"] == x["h"], F.lit(False))

    again = F.filter(v, lambda x, i: same(x, i - 1) | same(x, i + 1))
    s = F.col("starts")
    # A window covers three words, or as many as lie before the next one.
    covered = F.aggregate(
        F.transform(s, lambda x, i: F.least(F.lit(3), F.coalesce(F.get(s, i + 1) - x, F.lit(3)))),
        F.lit(0),
        lambda a, x: a + x,
    )
    return (
        base.withColumn("windows", windows)
        .withColumn("starts", F.sort_array(F.transform(again, lambda x: x["i"])))
        .select(
            "doc_id",
            "lang",
            "source",
            F.size("words").cast("long").alias("n_words"),
            "word_chars",
            "n_symbols",
            (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
            F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
        )
    )


def _vector(row: DataFrame) -> DataFrame:
    words = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    chars = F.greatest(F.col("word_chars"), F.lit(1)).cast("double")
    return row.withColumns(
        {
            "f0": F.log1p("n_words"),
            "f1": F.log(chars / words),
            "f2": F.sqrt(F.col("n_symbols") / chars),
            "f3": F.sqrt(F.col("n_repeat_words") / words),
            "f4": F.log1p(F.col("n_dup_lines")) / 4,
            "v2": 0.25 / chars,
            "v3": 6 * 0.25 / words,
            "v4": F.lit((math.log(2) / 8) ** 2),
        }
    )


def _bin(x: Column) -> Column:
    """The bin of a value of zero or more; far values have bins that widen with them."""
    far = LINEAR * BINS + F.floor(F.log2(F.greatest(x, F.lit(float(LINEAR))) / LINEAR) * BINS)
    return F.when(x < LINEAR, F.floor(x * BINS)).otherwise(far)


def _middle(number: Column) -> Column:
    """The middle of a bin."""
    far = LINEAR * F.pow(F.lit(2.0), (number - LINEAR * BINS + 0.5) / BINS)
    return F.when(number < LINEAR * BINS, (number + 0.5) / BINS).otherwise(far)


def _quantiles(values: DataFrame, by: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """Quantiles of ``value`` within groups, from a histogram: exact but for the width of a bin."""
    bins = values.groupBy(*by, _bin(F.col(value)).alias("bin")).agg(F.count("*").alias("n"))
    up = Window.partitionBy(*by).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    counted = bins.withColumns({"sum": F.sum("n").over(up), "all": F.sum("n").over(Window.partitionBy(*by))})
    return counted.groupBy(*by).agg(
        *(
            _middle(F.min(F.when(F.col("sum") >= share * F.col("all"), F.col("bin")))).alias(name)
            for name, share in shares.items()
        )
    )


def _spread_starts(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Two starts in the form of _estimate: medians with own spreads, and with those of all groups."""
    long = rows.select("g", F.posexplode(F.array(*FEATURES)).alias("j", "x"))
    middle = staged(_quantiles(long, ["g", "j"], "x", {"m": 0.5}), "medians")
    far = staged(long.join(middle, ["g", "j"]).select("g", "j", F.abs(F.col("x") - F.col("m")).alias("d")), "deviations")
    error = staged(rows.groupBy("g").agg(*(F.avg(v).alias(v) for v in VARIANCES)), "errors")
    everywhere = _quantiles(far, ["j"], "d", {"s": 0.5})
    zero = {f"w{i}{j}": F.lit(0.0) for i in range(5) for j in range(i)}
    starts = []
    for spread in (_quantiles(far, ["g", "j"], "d", {"s": 0.5}).join(middle, ["g", "j"]), middle.join(everywhere, "j")):
        columns = []
        for j, floor in enumerate(FLOORS):
            own = F.col("j") == j
            columns.append(F.max(F.when(own, F.col("m"))).alias(f"m{j}"))
            columns.append(F.max(F.when(own, F.col("s") * F.col("s") * 1.4826**2 + floor**2)).alias(f"s{j}"))
        total = spread.groupBy("g").agg(*columns).join(error, "g")
        inverse = {f"w{j}{j}": 1 / F.sqrt(F.col(f"s{j}") + (F.col(f"v{j}") if f"v{j}" in VARIANCES else 0)) for j in range(5)}
        found = total.withColumns({**inverse, **zero})
        starts.append(found.select("g", *PLACES))
    return starts[0], starts[1]


def _covariances(rows: DataFrame) -> DataFrame:
    """n, mean m0..m4 and plain covariance c00..c44 of each group, and its mean v2..v4 if they are there."""
    n = F.count("*").cast("double")
    sums = [F.avg(f).alias(f"m{i}") for i, f in enumerate(FEATURES)]
    sums += [F.avg(v).alias(v) for v in VARIANCES if v in rows.columns]
    squares = [
        F.avg(F.col(FEATURES[i]) * F.col(FEATURES[j])).alias(f"q{i}{j}") for i in range(5) for j in range(i + 1)
    ]
    out = rows.groupBy("g").agg(n.alias("n"), *sums, *squares)
    own = {f"c{i}{j}": F.col(f"q{i}{j}") - F.col(f"m{i}") * F.col(f"m{j}") for i, j in CELLS}
    return out.withColumns(own).drop(*(f"q{i}{j}" for i, j in CELLS))


def _pooled(covariances: DataFrame) -> DataFrame:
    """One row p00..p44: the mean covariance within groups, weighed by their rows."""
    n = F.sum("n")
    return covariances.agg(*(F.coalesce(F.sum(F.col("n") * F.col(f"c{i}{j}")) / n, F.lit(0.0)).alias(f"p{i}{j}") for i, j in CELLS))


def _estimate(rows: DataFrame, pooled: DataFrame | None = None) -> DataFrame:
    """Mean m0..m4, inverse Cholesky factor w00..w44 and log determinant of each group's covariance.

    ``pooled`` takes the place of the rows that a small group lacks.
    """
    return _factored(_covariances(rows), pooled)


def _factored(out: DataFrame, pooled: DataFrame | None) -> DataFrame:
    share = F.col("n") / (F.col("n") + PRIOR_ROWS)
    if pooled is not None:
        out = out.crossJoin(F.broadcast(pooled))
    changed = {}
    for i, j in CELLS:
        total = F.col(f"c{i}{j}") * share
        if pooled is not None:
            total = total + F.col(f"p{i}{j}") * (1 - share)
        if i == j:
            total = total + FLOORS[i] ** 2
            if f"v{i}" in out.columns:
                total = total + F.col(f"v{i}")
        changed[f"c{i}{j}"] = total
    out = out.withColumns(changed)
    for j in range(5):
        # A column of the factor in two projections, the inverse by its diagonals.
        rest = {i: sum((-F.col(f"l{i}{k}") * F.col(f"l{j}{k}") for k in range(j)), F.col(f"c{i}{j}")) for i in range(j, 5)}
        out = out.withColumn(f"l{j}{j}", F.sqrt(F.greatest(rest[j], F.lit(1e-9))))
        out = out.withColumns({f"l{i}{j}": rest[i] / F.col(f"l{j}{j}") for i in range(j + 1, 5)}) if j < 4 else out
    out = out.withColumns({f"w{i}{i}": 1 / F.col(f"l{i}{i}") for i in range(5)})
    for gap in range(1, 5):
        values = {}
        for j in range(5 - gap):
            i = j + gap
            total = sum((F.col(f"l{i}{k}") * F.col(f"w{k}{j}") for k in range(j, i)), F.lit(0.0))
            values[f"w{i}{j}"] = -total / F.col(f"l{i}{i}")
        out = out.withColumns(values)
    det = sum((F.log(f"l{i}{i}") for i in range(1, 5)), F.log("l00")) * 2
    return out.select("g", *PLACES, det.alias("det"))


def _distance() -> Column:
    total = F.lit(0.0)
    for i in range(5):
        y = F.lit(0.0)
        for j in range(i + 1):
            y = y + F.col(f"w{i}{j}") * (F.col(FEATURES[j]) - F.col(f"m{j}"))
        total = total + y * y
    return total


def _measured(rows: DataFrame, estimates: DataFrame) -> DataFrame:
    """The rows with d, the root of their squared distance; the estimates are a row per group."""
    drop = [c for c in estimates.columns if c != "g"]
    return rows.join(estimates, "g").withColumn("d", F.sqrt(_distance())).drop(*drop)


def _concentrated(rows: DataFrame, estimates: DataFrame) -> DataFrame:
    """The nearest rows of each group, by its estimate."""
    measured = _measured(rows, estimates)
    limits = staged(_quantiles(measured, ["g"], "d", {"limit": COMPACT}), "limits")
    edge = F.col("limit") + F.when(F.col("limit") < LINEAR, F.lit(1.0)).otherwise(F.col("limit")) / BINS
    return measured.join(limits, "g").where(F.col("d") <= edge)


def robust_estimates(rows: DataFrame) -> DataFrame:
    """(g, m.., w.., det, scale): centre, inverse factor and scale of distance of each group g.

    ``rows`` has g, the features and their variances. Every start takes some steps; the one with
    the least determinant goes on until it falls no more. The scale brings the median distance
    to that of a normal distribution, but never makes distances larger: where most rows have no
    symbols and no repeats, the median says nothing about the rest.
    """
    # A start is a part of the group's name, so that all of them take one pass.
    own, common = _spread_starts(rows)
    begun = [own, common, _estimate(rows, _pooled(_covariances(rows))).select("g", *PLACES)]
    named = F.array(*(F.concat(F.lit(f"{k}:"), "g") for k in range(STARTS)))
    every = rows.withColumn("g", F.explode(named))
    tried = begun[0].withColumn("g", F.concat(F.lit("0:"), "g"))
    for k in range(1, STARTS):
        tried = tried.unionByName(begun[k].withColumn("g", F.concat(F.lit(f"{k}:"), "g")))
    tried = staged(tried, "starts")
    pooled = None
    for step in range(FIRST_STEPS):
        found = staged(_covariances(_concentrated(every, tried)), "covariances")
        # One target for all starts and steps from here on, so that determinants can be compared.
        if step == 0:
            pooled = staged(_pooled(found), "pooled")
        tried = staged(_factored(found, pooled), "starts")
    bare = tried.withColumns({"start": F.substring("g", 1, 1), "g": F.expr("substring(g, 3)")})
    best = staged(
        bare.groupBy("g").agg(F.min_by(F.struct(*PLACES, "det"), F.struct("det", "start")).alias("e")).select("g", "e.*"), "mcd"
    )
    moving = best
    while True:
        # Staged before it is filtered: the filter would be pushed into the chain of factors.
        new = staged(_estimate(_concentrated(rows, moving), pooled), "moved")
        lower = new.join(best.select("g", F.col("det").alias("before")), "g").where(F.col("det") < F.col("before") - SETTLED)
        moving = staged(lower.drop("before"), "moving")
        if moving.isEmpty():
            break
        best = staged(best.join(moving.select("g"), "g", "left_anti").unionByName(moving), "mcd")
    middle = _quantiles(_measured(rows, best), ["g"], "d", {"middle": 0.5})
    scale = F.greatest(F.col("middle") * F.col("middle") / CHI_MEDIAN, F.lit(1.0))
    return staged(best.join(middle.select("g", scale.alias("scale")), "g"), "mcd")


def judge(docs: DataFrame) -> DataFrame:
    """doc_id, the counts, base_failed, distance and kept of every row of ``docs``.

    base_failed: fewer than 50 words, or over half of the words in repeated windows. Rows that
    fail are not kept and not estimated from; their distance is null. Of the others, rows with
    a squared distance beyond the limit are not kept. A null language or source is a value of
    its own. Repeated rows count each. Other columns are not looked at.
    """
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    group = F.to_json(F.struct("lang", "source"))
    rows = staged(_vector(statistics(docs).withColumns({"base_failed": failed, "g": group})), "statistics")
    estimates = robust_estimates(rows.where("not base_failed").select("g", *FEATURES, *VARIANCES))
    squared = F.when(~F.col("base_failed"), _distance() / F.col("scale"))
    return (
        rows.join(estimates, "g", "left")
        .withColumn("distance", squared)
        .select(
            "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
            F.coalesce(~F.col("base_failed") & (F.col("distance") <= CHI_LIMIT), F.lit(False)).alias("kept"),
            "distance",
        )
    )
