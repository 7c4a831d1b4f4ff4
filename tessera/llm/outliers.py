"""Quality rules and robust outliers: minimum-covariance-determinant estimates per language and source, in column expressions."""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.shared import saved

#: White space of the word rule, as a Java class and as the characters themselves.
_SPACE, _SPACES = r"[\x20\x09-\x0D]+", "' \\t\\n\\u000b\\u000c\\r'"
_BITS = 28  # of a place among a text's words

#: The transformed statistics, and the least standard deviation that each is given (a constant statistic has none).
#: Words that are a bare | separate the cells of a table; they are counted on their own and are no symbols here.
#: Documents with a share TABLE of such words are tables and form groups of their own, by whose statistics they are judged.
VECTOR = {
    "words": ("ln(1 + n_words)", 0.5),
    "word_length": ("ln(greatest(word_chars, 1) / greatest(n_words, 1))", 0.08),
    "symbols": ("ln(1 + 100 * (n_symbols - n_separators) / greatest(n_words, 1))", 0.5),
    "dup_lines": ("ln(1 + n_dup_lines)", 0.5),
    "repeats": ("ln(1 + 100 * n_repeat_words / greatest(n_words, 1))", 0.7),
}
CORE = 0.75  # share of a group whose covariance determinant is made small
STEPS = 60  # concentration steps at most; they end when no group's log determinant falls by SETTLED, else a warning says how many still fall
SETTLED = 1e-2
CONSISTENT = 1.412  # 0.75 over the share of chi-square with seven degrees below the 0.75 quantile of that with five: the core's covariance is so much too small
MIDDLE = 4.35  # median of the squared distance if the statistics were normal (five degrees of freedom)
CUT = 20.515  # squared distance beyond which a document goes: the 0.999 quantile of chi-square with five degrees of freedom
TABLE = 0.1
LEAST = 100  # documents of a group that has estimates of its own: 20 for each statistic. Others share their language's, then all documents'


def _with_repeats(rows: DataFrame) -> DataFrame:
    """rows (with words) and n_repeat_words: words in three-word windows that occur at least twice.

    A window's place is packed below the top bits of its hash, so one sort of longs finds the candidates; whole hashes
    confirm them.
    """
    window = lambda i: F.xxhash64(F.get("words", i), F.get("words", i + 1), F.get("words", i + 2))
    place = lambda x: x.bitwiseAND(F.lit((1 << _BITS) - 1).cast("long")).cast("int")
    top = lambda x: F.shiftright(x, _BITS)
    beside = lambda c, x, k, of: (F.coalesce(of(F.get(c, k + 1)) == of(x), F.lit(False))) | ((k > 0) & (of(F.get(c, k - 1)) == of(x)))
    packed = F.transform(F.expr("sequence(0, size(words) - 3)"), lambda i: F.shiftleft(top(window(i)), _BITS).bitwiseOR(i.cast("long")))
    rows = rows.withColumn("packed", F.when(F.size("words") >= 4, F.sort_array(packed)).otherwise(F.expr("cast(array() as array<bigint>)")))
    rows = rows.withColumn("maybe", F.filter("packed", lambda x, k: beside("packed", x, k, top)))
    rows = rows.withColumn("whole", F.array_sort(F.transform("maybe", lambda x: F.struct(window(place(x)).alias("h"), place(x).alias("i")))))
    rows = rows.withColumn("twice", F.sort_array(F.transform(F.filter("whole", lambda x, k: beside("whole", x, k, lambda v: v["h"])), lambda x: x["i"])))
    covered = F.transform("twice", lambda x, k: F.least(F.lit(3), F.coalesce(F.get("twice", k + 1) - x, F.lit(3))))
    return rows.withColumn("n_repeat_words", F.aggregate(covered, F.lit(0).cast("long"), lambda n, x: n + x))


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and the statistics of the whole text (null: no words) per row of docs."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select("doc_id", F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"), text.alias("text"))
    rows = rows.withColumn("inner", F.expr(f"trim(BOTH {_SPACES} FROM text)"))
    rows = rows.withColumn("words", F.when(F.col("inner") == "", F.expr("cast(array() as array<string>)")).otherwise(F.split("inner", _SPACE)))
    rows = rows.withColumn("lines", F.filter(F.split("text", "\n"), lambda x: F.length(F.trim(x, F.lit(" \t\n\x0b\f\r"))) > 0))
    long = lambda c: c.cast("long")
    return _with_repeats(rows).select(
        "doc_id", "lang", "source",
        long(F.size("words")).alias("n_words"),
        long(F.length(F.array_join("words", ""))).alias("word_chars"),
        long(F.length("text") - F.length(F.regexp_replace("text", r"[#*$%&|<>]+", ""))).alias("n_symbols"),
        long(F.size("lines") - F.size(F.array_distinct("lines"))).alias("n_dup_lines"),
        "n_repeat_words",
        long(F.size(F.filter("words", lambda x: x == "|"))).alias("n_separators"),
    )


def _quantiles(df: DataFrame, keys: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """Values of which the shares of each group's rows lie below, from counts of a grid column: one row a cell is shuffled."""
    cells = df.groupBy(*keys, value).agg(F.count("*").alias("k"))
    w = Window.partitionBy(*keys)
    upto, total = F.sum("k").over(w.orderBy(value)), F.sum("k").over(w)
    placed = cells.select(*keys, value, upto.alias("upto"), total.alias("total"))
    return placed.groupBy(*keys).agg(*(F.min(F.when(F.col("upto") >= q * F.col("total"), F.col(value))).alias(name) for name, q in shares.items()))


def _distance(rows: DataFrame, fit: DataFrame, d: int, keys: list[str], *also: str) -> DataFrame:
    """rows with d2, the squared Mahalanobis distance by its group's centre m and lower factor l, by forward substitution.

    fit is a small table read from files: a row a group, which is broadcast if its size allows. Expressions are text:
    a fit has hundreds, and as text they reach the planner in one call.
    """
    ys = [f"({' - '.join([f'x{i} - m{i}', *(f'l{i}{k} * y{k}' for k in range(i))])}) / l{i}{i} AS y{i}" for i in range(d)]
    return rows.join(fit, keys).selectExpr("*", *ys, f"{' + '.join(f'y{i} * y{i}' for i in range(d))} AS d2", *also)


_CELL = "floor(ln(d2 + 1e-6) * 64) AS cell"


def _pairs(d: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(d) for j in range(i + 1)]


def _moments(rows: DataFrame, keys: list[str], d: int) -> DataFrame:
    """Each group's size n, and its sums s and p of the statistics less the centre m that rows carry, and of their products."""
    z = [f"(x{i} - m{i})" for i in range(d)]
    sums = [*(f"sum({z[i]}) AS s{i}" for i in range(d)), *(f"sum({z[i]} * {z[j]}) AS p{i}{j}" for i, j in _pairs(d))]
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), *map(F.expr, sums))


def _fitted(sums: DataFrame, d: int, floors: list[float], keys: list[str]) -> DataFrame:
    """Centre m, Cholesky factor l and log determinant by _moments and the centre these were taken about; l's diagonal has floors."""
    factor = []
    for i, j in _pairs(d):
        rest = " - ".join([f"(p{i}{j} - s{i} * s{j} / n) / n", *(f"l{i}{k} * l{j}{k}" for k in range(j))])
        factor.append(f"sqrt(greatest({rest}, {floors[i] ** 2!r}D)) AS l{i}{i}" if i == j else f"({rest}) / l{j}{j} AS l{i}{j}")
    logdet = " + ".join(f"ln(l{i}{i})" for i in range(d))
    return sums.selectExpr(*keys, *(f"m{i} + s{i} / n AS m{i}" for i in range(d)), *factor, f"{logdet} AS logdet", "before")


def _concentrated(members: DataFrame, fit: DataFrame, core: float, floors: list[float], keys: list[str]) -> DataFrame:
    """The fit of each group's core share of rows nearest by fit. One pass: cells of the distance carry their rows' moments."""
    d = len(floors)
    cells = _moments(_distance(members, fit, d, keys, _CELL), [*keys, "cell"], d)
    w = f"OVER (PARTITION BY {', '.join(keys)}"
    placed = cells.selectExpr("*", f"sum(n) {w} ORDER BY cell) AS upto", f"sum(n) {w}) AS total")
    near = placed.filter(f"upto - n < {core!r}D * total")
    sums = near.groupBy(*keys).agg(*(F.expr(f"sum({c}) AS {c}") for c in cells.columns if c not in (*keys, "cell")))
    about = fit.selectExpr(*keys, *(f"m{i}" for i in range(d)), "logdet AS before")
    return _fitted(sums.join(about, keys), d, floors, keys)


def verdicts(stats: DataFrame, vector: dict[str, tuple[str, float]] | None = None, core: float = CORE, steps: int = STEPS, cut: float = CUT, least: int = LEAST) -> DataFrame:
    """stats (a table read from files) with distance2 and outlier.

    A row's group is its language, source and kind (table or text), its language and kind if that has fewer than least
    rows, its kind if that has too, or all rows. The estimates of a level are fitted on all of its rows, those with
    estimates of a narrower level too; a row's group only tells which estimates judge it.
    Each group starts twice, from medians with quartile ranges and from the mean and covariance of all its rows. A
    concentration step takes the core share with the smallest distances and fits its mean and covariance, which lowers
    the determinant; the steps end when no group's falls any more, and of its two fits a group keeps that with the
    smaller determinant. Distances are made consistent with a normal core, and scaled by the group's median where that
    still exceeds a normal one's. Ties in distance stand or fall together (grid cells).
    """
    vector = vector or VECTOR
    floors, d = [x[1] for x in vector.values()], len(vector)
    stats_of = stats.withColumn("kind", F.when(F.col("n_separators") >= TABLE * F.col("n_words"), "table").otherwise("text"))
    levels = [["lang", "source", "kind"], ["lang", "kind"], ["kind"]]
    level = stats_of.groupBy(*levels[0]).agg(F.count("*").alias("n0"))
    for k, cols in enumerate(levels[1:], 1):
        level = level.join(level.groupBy(*cols).agg(F.sum("n0").alias(f"n{k}")), cols)
    keys = [*(F.to_json(F.array(*cols)) for cols in levels), F.lit("[]")]
    level = saved(level.select(*levels[0], F.coalesce(*(F.when(F.col(f"n{k}") >= least, key) for k, key in enumerate(keys[:-1])), keys[-1]).alias("key"), F.array(*keys).alias("keys")), "levels")
    rows = saved(stats_of.join(level.drop("keys"), levels[0]).select("*", *(F.expr(e).cast("double").alias(f"x{i}") for i, (e, _) in enumerate(vector.values()))), "vectors")
    judges = level.select("key").distinct()  # each is fitted on every row of its level, whatever judges the row itself
    fitted = level.select(*levels[0], F.explode("keys").alias("key")).join(judges, "key", "left_semi")
    members = saved(rows.drop("key").join(fitted, levels[0]).select("key", *(f"x{i}" for i in range(d))), "members")

    long = members.selectExpr("key", f"posexplode(array({', '.join(f'floor(x{i} * 64)' for i in range(d))})) AS (i, cell)")
    start = _quantiles(long, ["key", "i"], "cell", {"low": 0.25, "mid": 0.5, "high": 0.75})
    middles = [f"max(CASE WHEN i = {i} THEN mid / 64 END) AS m{i}" for i in range(d)]
    spreads = [f"max(CASE WHEN i = {i} THEN greatest((high - low) / 64 / 1.349D, {floors[i]!r}D) END) AS l{i}{i}" for i in range(d)]
    start = start.groupBy("key").agg(*map(F.expr, middles + spreads))
    start = start.selectExpr("*", "0 AS start", *(f"0D AS l{i}{j}" for i, j in _pairs(d) if i > j), "1e9D AS logdet")
    zero = [f"0D AS m{i}" for i in range(d)]
    whole = _moments(members.selectExpr("*", *zero), ["key"], d).selectExpr("*", *zero, "1e9D AS before", "1 AS start")
    keys = ["key", "start"]
    fit = saved(start.unionByName(_fitted(whole, d, floors, keys).drop("before")), "fit")
    twice = members.withColumn("start", F.explode(F.array(F.lit(0), F.lit(1))))
    for _ in range(steps):
        fit = saved(_concentrated(twice, fit, core, floors, keys), "fit")
        falls, moving = fit.agg(F.max(F.col("before") - F.col("logdet")), F.count_if(F.col("before") - F.col("logdet") >= SETTLED)).first()
        fit = fit.drop("before")
        if falls is None or falls < SETTLED:
            break
    else:
        warnings.warn(f"after {steps} concentration steps, {moving} of the fits still have a determinant that falls", stacklevel=2)
    least_of = fit.groupBy("key").agg(F.min(F.struct("logdet", "start")).alias("r")).select("key", F.col("r.start").alias("start"))
    fit = saved(fit.join(least_of, keys).drop("start", "logdet"), "fit")
    at = _distance(members, fit, d, ["key"], _CELL)
    middle = F.exp((F.col("mid") + 0.5) / 64) / CONSISTENT / MIDDLE
    scale = saved(_quantiles(at, ["key"], "cell", {"mid": 0.5}).select("key", (CONSISTENT * F.greatest(F.lit(1.0), middle)).alias("scale")), "scale")
    out = _distance(rows, fit, d, ["key"]).join(scale, "key").withColumn("distance2", F.col("d2") / F.col("scale"))
    return out.select(*stats.columns, "distance2", (F.col("distance2") > cut).alias("outlier"))


def rules(docs: DataFrame) -> DataFrame:
    """Per row of docs: its statistics, base_failed, distance2 and kept.

    Null lang or source is the empty one; null or empty text has no words and fails the base rule. Documents that fail
    it take no part in the estimates. Repeated rows are each returned; other columns are not read. An empty table
    gives an empty result.
    """
    stats = saved(statistics(docs).withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))), "statistics")
    judged = verdicts(stats.filter("not base_failed"))
    failed = stats.filter("base_failed").select("*", F.lit(None).cast("double").alias("distance2"), F.lit(True).alias("outlier"))
    return judged.select(*failed.columns).union(failed).withColumn("kept", ~F.col("outlier"))


def report(found: DataFrame) -> DataFrame:
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("distance2", 3).alias("distance2"))
