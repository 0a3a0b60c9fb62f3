"""Quality rules with robust multivariate outliers, in DataFrame functions only.

Per language and source, the minimum covariance determinant of transformed statistics of the texts is searched from
several starts: the covariance of all rows and those of small hashed subsets. A concentration step takes the distances
under a start's centre and covariance, keeps the ``share`` of smallest ones, and takes centre and covariance of those.
After two steps the starts of least determinant go on until the determinant falls no more, and the least is kept. Texts
far from their group's centre by Mahalanobis distance are rejected. Every step is one set of sums for all groups and
starts; sums are of whole numbers, so that neither order nor layout of the rows changes a result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pelagos.llm import common

#: Transformed statistics: name, and the standard deviation that a group is taken to have at least.
STATS = (("x_word_length", 0.1), ("x_symbols", 0.25), ("x_dup_lines", 0.35), ("x_repeats", 0.35), ("x_capitals", 0.4))
#: Covariance of the 3/4 nearest of five normal variables is this much too small: 0.75 / P(chi2_7 <= 6.626).
CONSISTENCY = 1.41
#: 0.9999 quantile of chi2 with five degrees of freedom.
CUTOFF = 25.74
#: Statistics are counted in steps of 1 / SCALE, so that sums are exact; sums of their products fit a long for 10^12 rows of
#: usual texts, and an error is raised beyond.
SCALE = 1000
#: Distances fall into this many classes each time they grow by e; the share of smallest ones ends with a class.
CLASSES = 128
SYMBOLS = "#*$%&|<>"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
WHITE = " \t\n\x0b\f\r"


def _repeat_words(words: Column) -> Column:
    """Words in three-word windows that come twice or more in the text; windows are sorted by hash to find them."""

    def covered(places: Column) -> Column:
        start = F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("n"))
        add = lambda acc, p: F.struct(p.alias("last"), (acc["n"] + F.least(F.lit(3), p - acc["last"])).alias("n"))
        return F.aggregate(places, start, add, lambda acc: acc["n"])

    def twice(s: Column) -> Column:
        same = lambda x, j: F.coalesce(x["h"] == F.get(s, j)["h"], F.lit(False))
        return F.array_sort(F.transform(F.filter(s, lambda x, i: same(x, i - 1) | same(x, i + 1)), lambda x: x["p"]))

    windows = lambda w: F.transform(
        F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.struct(F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("p"))
    )
    count = common.let(words, lambda w: F.when(F.size(w) >= 3, common.let(F.array_sort(windows(w)), lambda s: covered(twice(s)))))
    return F.coalesce(count, F.lit(0)).cast("long")


def statistics(docs: DataFrame) -> DataFrame:
    """Row-wise statistics of ``docs(doc_id, text, lang, source)`` and their transforms; texts are read whole."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    base = docs.select("doc_id", F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), text.alias("text"))
    words = F.filter(F.split("text", common.SPACE), lambda w: w != "")
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    without = lambda chars: F.length(F.translate("text", chars, ""))
    counted = base.select(
        "doc_id",
        "lang",
        "source",
        F.size(words).cast("long").alias("n_words"),
        without(WHITE).cast("long").alias("word_chars"),
        (F.length("text") - without(SYMBOLS)).cast("long").alias("n_symbols"),
        common.let(lines, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup"))).alias("l"),
        _repeat_words(words).alias("n_repeat_words"),
        (F.length("text") - without(CAPITALS)).alias("capitals"),
    )
    share = lambda x, y, scale: F.asinh(x / F.greatest(y, F.lit(1)) / scale)
    return counted.select(
        "doc_id", "lang", "source", "n_words", "word_chars", "n_symbols", F.col("l.dup").alias("n_dup_lines"), "n_repeat_words",
        ((F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))).alias("base_failed"),
        F.ln(F.greatest("word_chars", F.lit(1)) / F.greatest("n_words", F.lit(1))).alias("x_word_length"),
        share(F.col("n_symbols"), F.col("word_chars"), 0.02).alias("x_symbols"),
        share(F.col("l.dup"), F.col("l.n"), 0.2).alias("x_dup_lines"),
        share(F.col("n_repeat_words"), F.col("n_words"), 0.2).alias("x_repeats"),
        share(F.col("capitals"), F.col("word_chars"), 0.05).alias("x_capitals"),
    )


def _levels(rows: DataFrame) -> DataFrame:
    """``rows`` with the names of their groups: ``g2`` of language and source, ``g1`` of the language, ``g0`` of all."""
    name = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit("null"))
    return rows.withColumns({"g2": F.concat_ws("\x01", F.lit("2"), name("lang"), name("source")), "g1": F.concat_ws("\x01", F.lit("1"), name("lang")), "g0": F.lit("0")})


def _factor(params: DataFrame, names: list[str], floors: list[float]) -> DataFrame:
    """Cholesky factor of each group's covariance (its consistency factor and least deviations applied), as ``l_i_j``."""
    for i in range(len(names)):
        for j in range(i + 1):
            entry = CONSISTENCY * F.col(f"c_{j}_{i}") + (floors[i] ** 2 if i == j else 0.0)
            for k in range(j):
                entry = entry - F.col(f"l_{i}_{k}") * F.col(f"l_{j}_{k}")
            params = params.withColumn(f"l_{i}_{j}", F.sqrt(F.greatest(entry, F.lit(1e-12))) if i == j else entry / F.col(f"l_{j}_{j}"))
    return params


def _distance(names: list[str]) -> list[tuple[str, Column]]:
    """Columns of the forward substitution, and last the squared Mahalanobis distance."""
    out = []
    for i, n in enumerate(names):
        y = F.col(n) - F.col(f"m_{i}")
        for k in range(i):
            y = y - F.col(f"l_{i}_{k}") * F.col(f"y_{k}")
        out.append((f"y_{i}", y / F.col(f"l_{i}_{i}")))
    return [*out, ("d2", sum((F.col(f"y_{i}") * F.col(f"y_{i}") for i in range(1, len(names))), F.col("y_0") * F.col("y_0")))]


def _far(rows: DataFrame, params: DataFrame, names: list[str]) -> DataFrame:
    rows = rows.join(common.small_or_shuffled(params), "g")
    for name, column in _distance(names):
        rows = rows.withColumn(name, column)
    return rows


def _moments(near: DataFrame, names: list[str]) -> DataFrame:
    """Rows ``n``, centre ``m_i`` and covariance ``c_i_j`` per group and start, out of exact sums of the steps ``q_i``."""
    k = range(len(names))
    sums = near.groupBy("g", "start").agg(
        F.count("*").alias("n"),
        *[F.sum(f"q_{i}").cast("double").alias(f"s_{i}") for i in k],
        *[F.sum(F.col(f"q_{i}") * F.col(f"q_{j}")).cast("double").alias(f"p_{i}_{j}") for i in k for j in k if i <= j],
    )
    return sums.select(
        "g", "start", "n",
        *[(F.col(f"s_{i}") / F.col("n") / SCALE).alias(f"m_{i}") for i in k],
        *[((F.col(f"p_{i}_{j}") - F.col(f"s_{i}") * F.col(f"s_{j}") / F.col("n")) / F.col("n") / SCALE**2).alias(f"c_{i}_{j}") for i in k for j in k if i <= j],
    )


def _step(rows: DataFrame, params: DataFrame, names: list[str], floors: list[float], share: float) -> DataFrame:
    """Centre, covariance, factor and determinant of the ``share`` of rows nearest under ``params``, per group and start."""
    far = _far(rows, params.select("g", "start", *[c for c in params.columns if c[:2] in ("m_", "l_")]), names)
    steps = [f"q_{i}" for i in range(len(names))]
    far = far.select("g", "start", *steps, F.floor(F.ln(F.greatest("d2", F.lit(1e-9))) * CLASSES).alias("class"))
    counted = far.groupBy("g", "start", "class").count()
    group = Window.partitionBy("g", "start")
    upto = counted.select("g", "start", "class", F.sum("count").over(group.orderBy("class")).alias("upto"), F.sum("count").over(group).alias("all"))
    # Written first: a table of one row per group and start is then known to be small, and no rows are shuffled to meet it.
    cut = common.materialize(upto.where(F.col("upto") >= F.ceil(share * F.col("all"))).groupBy("g", "start").agg(F.min("class").alias("cut")), "cut")
    near = far.join(common.small_or_shuffled(cut), ["g", "start"]).where("class <= cut")
    found = _factor(_moments(near, names), names, floors)
    return found.withColumn("det", sum((F.ln(f"l_{i}_{i}") for i in range(1, len(names))), F.ln("l_0_0")))


def _least(params: DataFrame, most: int) -> DataFrame:
    """The ``most`` starts of least determinant of each group."""
    place = F.row_number().over(Window.partitionBy("g").orderBy("det", "start"))
    return params.withColumn("place", place).where(F.col("place") <= most).drop("place")


def estimate(rows: DataFrame, share: float = 0.75, starts: int = 8, subset: int = 12, steps: int = 30, nested: int = 1500) -> DataFrame:
    """``g, n, m_i, c_i_j, det`` of least determinant per group of ``rows(g, draw, x_...)``.

    ``starts`` hashed subsets of about ``subset`` rows (``draw`` decides) and the group as a whole take two concentration
    steps over about ``nested`` rows of each group, or all that it has; the two best go on over all rows until the
    determinant's logarithm falls by less than 1e-6, ``steps`` at most.
    """
    names, floors = [n for n, _ in STATS], [s for _, s in STATS]
    sizes = common.small_or_shuffled(common.materialize(rows.groupBy("g").agg(F.count("*").alias("size")), "sizes"))
    unit = lambda k: F.shiftrightunsigned(F.xxhash64("draw", F.lit(k)), 11) / float(1 << 53)
    rows = rows.select("g", "draw", *[F.round(F.col(n) * SCALE).cast("long").alias(f"q_{i}") for i, n in enumerate(names)])
    whole = [f"q_{i}" for i in range(len(names))]
    some = common.materialize(rows.join(sizes, "g").where(unit(starts + 1) * F.col("size") < nested), "nested")
    chosen = F.array(F.lit(0), *[F.when(unit(k) * F.least("size", F.lit(nested)) < subset, k) for k in range(1, starts + 1)])
    drawn = some.select("g", *whole, F.explode(F.array_compact(chosen)).alias("start"))
    params = common.materialize(_factor(_moments(drawn, names), names, floors), "starts")
    scaled = lambda df: df.select("g", *whole, *[(F.col(q) / SCALE).alias(n) for q, n in zip(whole, names, strict=True)])
    for _ in range(2):
        params = common.materialize(_step(scaled(some), params, names, floors, share), "mcd")
    rows = scaled(rows)
    live = common.materialize(_least(params, 2), "mcd")
    settled = []
    for _ in range(steps):
        after = common.materialize(_step(rows, live, names, floors, share), "mcd")
        both = live.join(after.select("g", "start", F.col("det").alias("det_after")), ["g", "start"])
        falls = F.col("det_after") < F.col("det") - 1e-6
        settled.append(both.where(~falls).select(*live.columns))
        live = common.materialize(after.join(both.where(falls).select("g", "start"), ["g", "start"]).select(*live.columns), "live")
        if live.isEmpty():
            break
    for part in settled:
        live = live.unionByName(part)
    k = range(len(names))
    return _least(live, 1).select("g", "n", *[f"m_{i}" for i in k], *[f"c_{i}_{j}" for i in k for j in k if i <= j], "det")


def _shrunk(narrow: DataFrame, wide: DataFrame, prior: float, names: list[str]) -> DataFrame:
    """Centre and covariance of each row of ``narrow``, those of its wider group mixed in as if ``prior`` rows were of them."""
    values = [f"m_{i}" for i in range(len(names))] + [f"c_{i}_{j}" for i in range(len(names)) for j in range(i, len(names))]
    wider = wide.select(F.col("g").alias("wider"), *[F.col(v).alias(f"w_{v}") for v in values])
    mean = lambda v: (F.col("n") * F.col(v) + prior * F.col(f"w_{v}")) / (F.col("n") + prior)
    return narrow.join(wider, "wider").select(*[c for c in narrow.columns if c not in (*values, "wider")], *[mean(v).alias(v) for v in values])


def judge(docs: DataFrame, prior: float = 50, share: float = 0.75, cutoff: float = CUTOFF) -> DataFrame:
    """The statistics, ``base_failed``, ``distance`` and ``kept`` of every row of ``docs(doc_id, text, lang, source)``.

    Rows that fail the base rules are not kept and not estimated from. A row is kept if its squared Mahalanobis
    distance is at most ``cutoff``. The estimate of a language and source is mixed with its language's, weighing as
    many rows as it rests on against ``prior``, and that of the language likewise with that of all rows: a group of one
    row is judged by its language, one of thousands by itself. Null texts have no words; null language or source are
    groups of their own; repeated rows count as often as they come; other columns are ignored; an empty table gives no
    rows.
    """
    stats = common.materialize(statistics(docs), "statistics")
    names, floors = [n for n, _ in STATS], [s for _, s in STATS]
    rows = _levels(stats.where(~F.col("base_failed")))
    draw = F.xxhash64("doc_id", "n_words", "word_chars", *names).alias("draw")
    found = common.materialize(estimate(rows.select(F.explode(F.array("g0", "g1", "g2")).alias("g"), draw, *names), share), "estimates")
    level = lambda k: found.where(F.col("g").startswith(str(k)))
    languages = _shrunk(level(1).withColumn("wider", F.lit("0")), level(0), prior, names)
    groups = _shrunk(rows.select("g2", "g1").distinct().withColumnsRenamed({"g2": "g", "g1": "wider"}).join(level(2), "g"), languages, prior, names)
    params = common.materialize(_factor(groups, names, floors).drop("n", "det"), "mcd")
    judged = _far(rows.withColumnRenamed("g2", "g"), params, names).select(*stats.columns, F.sqrt("d2").alias("distance"), (F.col("d2") <= cutoff).alias("kept"))
    failed = stats.where("base_failed").select("*", F.lit(None).cast("double").alias("distance"), F.lit(False).alias("kept"))
    return judged.unionByName(failed)
