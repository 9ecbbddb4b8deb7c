"""Quality rules: robust multivariate outliers by minimum covariance determinant (MCD).

Every document becomes a short vector of transformed statistics. Per language and source, the share ``KEEP`` of documents
whose covariance has the smallest determinant is sought by concentration steps: each takes the documents nearest by
Mahalanobis distance and estimates mean and covariance again from them. There are three starts (medians and quartile ranges;
mean and covariance of all; directions from the medians). Each goes on until its determinant stops falling, and the least
determinant of all starts and steps wins. Documents beyond the ``CUTOFF`` of the final distance are rejected, and so are those
that fail the base rules.

Every group is judged, whatever its size: its estimate is drawn towards that of its language by the weight of ``PRIOR``
documents, and a language's towards that of all documents. These two are estimated in the same way and in the same passes.

Scale: a document's statistics are built from its own words in one row (no shuffle). The steps read a staged table of a few
numbers per document; each is one join with the estimates and one aggregation by (group, start, distance bin) with partial
sums, so a source with a third of all rows is summed where it is read. The vectors are integers (fixed point), so sums don't
depend on the order of tasks and a lost executor or a second run can't move a verdict. Starts that have come to rest are not
read again. Nothing but the estimates (three rows per language and source) is joined.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from capindex.llm.common import BLANKS, broadcast_if_small, grams, stage, text_or_empty, words_of

WINDOW = 5
MIN_WORDS, MAX_REPEAT_PCT = 10, 20
#: Share of a group's documents that the covariance is estimated from.
KEEP = 0.75
#: A start goes on while a step lowers the logarithm of its determinant by more than this.
FALL = 0.01
#: Documents whose tail probability under the group's normal distribution is below this are rejected.
TAIL = 1e-3
#: Weight, in documents, of the estimate of the language in that of a group, and of all documents in that of a language.
PRIOR = 60
#: Fixed point: units per 1.0 of a statistic.
UNIT = 4096
#: Statistic and its least standard deviation: what honest texts vary by even where a group's core is constant.
STATS = {"word_len": 0.10, "symbols": 0.06, "capitals": 0.08, "marks": 0.08, "repeats": 0.15, "stutter": 0.10}
#: What stands for all languages or all sources; given ones have a prefix, and null is the empty string.
ALL = "*"
BINS_PER_E = 32
#: Fixed point of products of directions.
TURN = 1 << 20
#: Most bytes of an estimate in a join: keys, centre and inverse.
ROW_BYTES = 512


def _share(part: Column, whole: Column, prior: float, weight: float) -> Column:
    """Angle of a share, drawn towards ``prior`` by ``weight`` pseudo-counts, so that short texts don't stand out."""
    return F.asin(F.sqrt(F.least(F.lit(1.0), (part + prior * weight) / (whole + weight))))


def _count(text: Column, chars: str) -> Column:
    return (F.char_length(text) - F.char_length(F.regexp_replace(text, chars, ""))).cast("bigint")


def text_statistics(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_capitals, n_marks, n_stutter (words
    equal to the one before) and base_failed.

    Null texts count as empty (all 0, base_failed). Columns of these names in ``df`` are replaced.
    """
    t, ws = text_or_empty(F.col(f"`{text}`")), F.col("__q_words")
    lines = F.filter(F.split(t, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    out = df.withColumns({
        "__q_words": words_of(F.col(f"`{text}`")), "__q_lines": lines, "n_symbols": _count(t, "[#*$%&|<>]"),
        "n_capitals": _count(t, r"\p{Lu}"), "n_marks": _count(t, "[!?.,;:]"),
        "word_chars": F.char_length(F.regexp_replace(t, BLANKS, "")).cast("bigint")})
    out = out.withColumns({
        "n_words": F.size(ws).cast("bigint"),
        "n_dup_lines": (F.size("__q_lines") - F.size(F.array_distinct("__q_lines"))).cast("bigint"),
        "__q_hash": F.transform(ws, lambda w: F.xxhash64(w))}).drop("__q_words", "__q_lines")
    h = F.col("__q_hash")
    out = out.withColumn("__q_window", grams(h, WINDOW, F.col("n_words"))).withColumn("n_stutter", F.size(F.filter(
            h, lambda x, i: F.coalesce(x == F.get(h, i - 1), F.lit(False)))).cast("bigint")).drop("__q_hash")
    w, p = F.col("__q_window"), F.col("__q_pairs")
    # Only texts with a window twice are sorted; the others have no repeated words.
    out = out.withColumn("__q_pairs", F.when(F.size(F.array_distinct(w)) < F.size(w), F.sort_array(
        F.transform(w, lambda x, i: F.struct(x.alias("h"), i.alias("i")))))).drop("__q_window")
    out = out.withColumn("__q_at", F.sort_array(F.transform(F.filter(p, lambda x, i: F.coalesce(
        x["h"] == F.get(p, i - 1)["h"], F.lit(False)) | F.coalesce(x["h"] == F.get(p, i + 1)["h"], F.lit(False))),
        lambda x: x["i"]))).drop("__q_pairs")
    # A window at i covers what the window before it, at j, left open: min(5, i - j) words.
    covered = F.aggregate(
        F.col("__q_at"), F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).cast("bigint").alias("n")),
        lambda acc, i: F.struct(i.alias("last"), (acc["n"] + F.least(F.lit(WINDOW), i - acc["last"])).alias("n")),
        lambda acc: acc["n"])
    out = out.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0).cast("bigint"))).drop("__q_at")
    return out.withColumn("base_failed", (F.col("n_words") < MIN_WORDS)
                          | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PCT))


def _vector() -> dict[str, Column]:
    c, n = F.col("word_chars"), F.col("n_words")
    parts = {
        "word_len": F.log((c + 50.0) / (n + 10.0)), "symbols": _share(F.col("n_symbols"), c, 0.001, 100),
        "capitals": _share(F.col("n_capitals"), c, 0.03, 100), "marks": _share(F.col("n_marks"), c, 0.03, 100),
        "repeats": _share(F.col("n_repeat_words"), n, 0.01, 50),
        "stutter": _share(F.col("n_stutter"), n, 0.005, 20)}
    return {f"__q_z_{k}": F.round(v * UNIT).cast("bigint") for k, v in parts.items()}


def _gamma_p(a: float, x: float) -> float:
    """Regularised lower incomplete gamma function, by its series."""
    term = total = 1 / a
    n = a
    while term > total * 1e-16:
        n += 1
        term *= x / n
        total += term
    return total * math.exp(-x + a * math.log(x) - math.lgamma(a))


def _chi2_quantile(tail: float, k: int) -> float:
    low, high = 1e-9, 1000.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if 1 - _gamma_p(k / 2, mid / 2) > tail else (low, mid)
    return high


P = len(STATS)
Z = [f"__q_z_{k}" for k in STATS]
CUTOFF = _chi2_quantile(TAIL, P)
#: The covariance of the nearest share of a normal sample is too small by this factor.
CONSISTENCY = KEEP / _gamma_p((P + 2) / 2, _chi2_quantile(1 - KEEP, P) / 2)


PAIRS = [(i, j) for i in range(P) for j in range(i, P)]
FLOORS = list(STATS.values())
POOL = ["__q_lang", "__q_source"]


def _cov(values: dict[tuple[int, int], Column]) -> list[Column]:
    """Covariance columns c_i_j, with the least variances added on the diagonal."""
    return [(v + FLOORS[i] ** 2 if i == j else v).alias(f"c_{i}_{j}") for (i, j), v in values.items()]


def _inverse(est: DataFrame) -> DataFrame:
    """``est`` with the inverse i_j_k (j <= k) of the covariance c_j_k and log_det: one sweep per row of the matrix."""
    given = est.columns
    est = est.withColumns({f"i_{i}_{j}": F.col(f"c_{i}_{j}") for i, j in PAIRS} | {"log_det": F.lit(0.0)})
    a = {(i, j): F.col(f"i_{min(i, j)}_{max(i, j)}") for i in range(P) for j in range(P)}
    for k in range(P):
        d, new = a[k, k], {}
        for i, j in PAIRS:
            if i == j == k:
                new[i, j] = -1 / d
            elif k in (i, j):
                new[i, j] = a[i, j] / d
            else:
                new[i, j] = a[i, j] - a[i, k] * a[k, j] / d
        est = est.withColumns({f"i_{i}_{j}": v for (i, j), v in new.items()} | {"log_det": F.col("log_det") + F.log(d)})
    return est.select(*given, "log_det", *[(-F.col(f"i_{i}_{j}")).alias(f"i_{i}_{j}") for i, j in PAIRS])


def _distance() -> Column:
    x = [F.col(Z[i]) / UNIT - F.col(f"m_{i}") for i in range(P)]
    total = F.lit(0.0)
    for i in range(P):
        for j in range(i, P):
            total = total + x[i] * x[j] * F.col(f"i_{i}_{j}") * (1.0 if i == j else 2.0)
    return total


def _medians(rows: DataFrame) -> DataFrame:
    """First start: medians and quartile ranges of each pool, from counts of fixed-point values in steps of UNIT / 64."""
    width = UNIT // 64
    cells = rows.select(*POOL, F.posexplode(F.array(*[F.floor(F.col(z) / width) for z in Z])).alias("dim", "cell")).groupBy(
        *POOL, "dim", "cell").agg(F.count("*").alias("n"))
    of = Window.partitionBy(*POOL, "dim")
    run = cells.withColumn("up_to", F.sum("n").over(of.orderBy("cell"))).withColumn("all", F.sum("n").over(of))
    at = lambda q: (F.min(F.when(F.col("up_to") >= q * F.col("all"), F.col("cell"))) + 0.5) / 64
    q = run.groupBy(*POOL, "dim").agg(at(0.25).alias("low"), at(0.5).alias("mid"), at(0.75).alias("high"), F.max("all").alias("n"))
    pick = lambda i, c: F.max(F.when(F.col("dim") == i, c))
    sd = (F.col("high") - F.col("low")) / 1.349
    return q.groupBy(*POOL).agg(
        F.lit(0).alias("start"), F.max("n").alias("n"), *[pick(i, F.col("mid")).alias(f"m_{i}") for i in range(P)],
        *_cov({(i, j): pick(i, sd * sd) if i == j else F.lit(0.0) for i, j in PAIRS}))


def _more_starts(rows: DataFrame, medians: DataFrame) -> DataFrame:
    """Second start: mean and covariance of all. Third: medians, with the covariance of the directions from them."""
    u = [(F.col(z) / UNIT - F.col(f"m_{i}")) / F.sqrt(F.col(f"c_{i}_{i}")) for i, z in enumerate(Z)]
    far = sum((x * x for x in u[1:]), u[0] * u[0])
    turned = [F.round(u[i] * u[j] / F.greatest(far, F.lit(1e-9)) * TURN).cast("bigint") for i, j in PAIRS]
    named = rows.join(broadcast_if_small(medians, ROW_BYTES), POOL).withColumns({f"t_{i}_{j}": t for (i, j), t in zip(PAIRS, turned, strict=True)})
    tot = named.groupBy(*POOL).agg(
        F.max("n").alias("n"), *[F.max(f"m_{i}").alias(f"m_{i}") for i in range(P)],
        *[F.sqrt(F.max(f"c_{i}_{i}")).alias(f"d_{i}") for i in range(P)], *_sums(),
        *[F.sum(f"t_{i}_{j}").alias(f"t_{i}_{j}") for i, j in PAIRS])
    n, mean = F.col("n"), [F.col(f"s_{i}") / F.col("n") / UNIT for i in range(P)]
    plain = tot.select(*POOL, F.lit(1).alias("start"), "n", *[m.alias(f"m_{i}") for i, m in enumerate(mean)], *_cov(
        {(i, j): F.col(f"s_{i}_{j}") / n / UNIT / UNIT - mean[i] * mean[j] for i, j in PAIRS}))
    turns = tot.select(*POOL, F.lit(2).alias("start"), "n", *[f"m_{i}" for i in range(P)], *_cov(
        {(i, j): F.col(f"t_{i}_{j}") / n / TURN * P * F.col(f"d_{i}") * F.col(f"d_{j}") for i, j in PAIRS}))
    return plain.unionByName(turns)


def _sums() -> list[Column]:
    return [F.sum(z).alias(f"s_{i}") for i, z in enumerate(Z)] + [F.sum(F.col(Z[i]) * F.col(Z[j])).alias(f"s_{i}_{j}") for i, j in PAIRS]


def _step(rows: DataFrame, at: DataFrame) -> DataFrame:
    """Mean and covariance of the nearest share of each pool, for each start. Rows are summed by distance bin; the bin in which
    the share is reached counts in part, so the weights add up to the share without a sort or an approximate quantile."""
    near = rows.join(broadcast_if_small(at.select(*POOL, "start", *[f"m_{i}" for i in range(P)], *[f"i_{i}_{j}" for i, j in PAIRS]), ROW_BYTES), POOL)
    bins = near.withColumn("bin", F.floor(F.log(F.greatest(_distance(), F.lit(0.0)) + 1e-3) * BINS_PER_E)).groupBy(
        *POOL, "start", "bin").agg(F.count("*").alias("n"), *_sums())
    of = Window.partitionBy(*POOL, "start")
    bins = bins.withColumn("upto", F.sum("n").over(of.orderBy("bin"))).withColumn("all", F.sum("n").over(of)).where(
        F.col("upto") - F.col("n") < KEEP * F.col("all"))
    last, share = F.col("upto") >= KEEP * F.col("all"), (KEEP * F.col("all") - F.col("upto") + F.col("n")) / F.col("n")
    named = [c for c in bins.columns if c.startswith("s_")]
    tot = bins.groupBy(*POOL, "start").agg(F.max("all").alias("n"), *[
        (F.coalesce(F.sum(F.when(~last, F.col(c))), F.lit(0)) + F.max(F.when(last, F.col(c) * share))).alias(c) for c in named])
    n = F.col("n") * KEEP
    mean = [F.col(f"s_{i}") / n / UNIT for i in range(P)]
    return tot.select(*POOL, "start", "n", *[m.alias(f"m_{i}") for i, m in enumerate(mean)], *_cov(
        {(i, j): (F.col(f"s_{i}_{j}") / n / UNIT / UNIT - mean[i] * mean[j]) * CONSISTENCY for i, j in PAIRS}))


def mcd(rows: DataFrame) -> DataFrame:
    """Per pool (__q_lang, __q_source) of ``rows`` with the z columns: n, m_i, c_i_j and log_det of the least determinant found.

    Each round lowers some determinant by ``FALL`` at least, and the least variances bound determinants from below, so
    the rounds come to an end."""
    first = stage(_medians(rows), "quality-medians")
    starts = first.unionByName(_more_starts(rows, first))
    at = stage(_inverse(stage(starts, "quality-starts")), "quality-step")
    seen: list[DataFrame] = []
    while True:
        new = stage(_inverse(stage(_step(rows, at), "quality-sums")), "quality-step")
        seen.append(new)
        # The starts are no subsets of the share, so their determinants say nothing.
        falls = new if len(seen) == 1 else new.join(
            at.select(*POOL, "start", F.col("log_det").alias("was")), [*POOL, "start"]).where(F.col("log_det") < F.col("was") - FALL).drop("was")
        if not falls.count():
            break
        at = falls
    found = seen[0]
    for more in seen[1:]:
        found = found.unionByName(more)
    keep = ["n", "log_det", *[f"m_{i}" for i in range(P)], *[f"c_{i}_{j}" for i, j in PAIRS]]
    best = found.groupBy(*POOL).agg(F.min(F.struct("log_det", "start", *[c for c in keep if c != "log_det"])).alias("b"))
    return best.select(*POOL, *[F.col(f"b.{c}").alias(c) for c in keep])


def _drawn(est: DataFrame, towards: DataFrame, up: str) -> DataFrame:
    """``est`` drawn towards the estimate of the row of ``towards`` whose language is in the column ``up``."""
    named = [f"m_{i}" for i in range(P)] + [f"c_{i}_{j}" for i, j in PAIRS]
    other = towards.select(F.col("__q_lang").alias("up"), *[F.col(c).alias(f"up_{c}") for c in named])
    w = F.col("n") / (F.col("n") + PRIOR)
    return est.withColumn("up", F.col(up)).join(other, "up").select(*POOL, "n", *[
        (w * F.col(c) + (1 - w) * F.col(f"up_{c}")).alias(c) for c in named])


def mcd_estimates(vectors: DataFrame) -> DataFrame:
    """Estimates (m_i, i_j_k) of each group (__q_lang, __q_source) from rows of these and the z columns."""
    lang, source = F.col("__q_lang"), F.col("__q_source")
    pools = F.array(*[F.struct(a.alias("__q_lang"), b.alias("__q_source")) for a, b in (
        (lang, source), (lang, F.lit(ALL)), (F.lit(ALL), F.lit(ALL)))])
    best = stage(mcd(vectors.select(F.inline(pools), *Z)), "quality-best")
    of_all, of_lang = best.where(lang == ALL), best.where((lang != ALL) & (source == ALL))
    langs = stage(_drawn(of_lang, of_all, "__q_source"), "quality-languages")
    groups = stage(_drawn(best.where(source != ALL), langs, "__q_lang"), "quality-groups")
    return stage(_inverse(groups), "quality-final").select(*POOL, *[f"m_{i}" for i in range(P)], *[f"i_{i}_{j}" for i, j in PAIRS])


def judge(df: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """``df`` with the statistics of ``text_statistics``, base_failed, distance (squared) and kept.

    Estimates come from documents that pass the base rules; null languages and sources are groups of their own.
    Documents with base_failed have a null distance. Repeated rows are judged alike; an empty table stays empty. Columns of
    the names of the statistics are replaced (``good`` leaves them), all others pass through, whatever their names.
    """
    out, names = _judged(df, text, lang, source)
    own = [c for c in out.columns if c not in names.values()]
    return out.select(*[F.col(n).alias(c) for c, n in names.items() if c not in own], *own)


def good(df: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """The rows of ``df`` that ``judge`` keeps, with its columns as they are."""
    out, names = _judged(df, text, lang, source)
    return out.where("kept").select(*[F.col(n).alias(c) for c, n in names.items()])


def _judged(df: DataFrame, text: str, lang: str, source: str) -> tuple[DataFrame, dict[str, str]]:
    """Statistics and verdicts beside the columns of ``df`` under other names, which can't clash with anything."""
    names = {c: f"__q_given_{i}" for i, c in enumerate(df.columns)}
    rows = df.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()])
    return _verdicts(stage(_with_vector(rows, names[text], names[lang], names[source]), "quality-statistics")), names


def _with_vector(df: DataFrame, text: str, lang: str, source: str) -> DataFrame:
    group = lambda c: F.coalesce(F.concat(F.lit("="), F.col(f"`{c}`").cast("string")), F.lit(""))
    return text_statistics(df, text).withColumns({"__q_lang": group(lang), "__q_source": group(source)}).withColumns(_vector())


def _verdicts(rows: DataFrame) -> DataFrame:
    est = mcd_estimates(rows.where(~F.col("base_failed")).select(*POOL, *Z))
    judged = rows.join(broadcast_if_small(est, ROW_BYTES), POOL, "left")
    out = judged.withColumn("distance", F.when(~F.col("base_failed"), _distance())).withColumn(
        "kept", ~F.col("base_failed") & (F.coalesce(F.col("distance"), F.lit(0.0)) <= CUTOFF))
    return out.select(*[F.col(f"`{c}`") for c in rows.columns if c not in (*POOL, *Z)], "distance", "kept")


def quality_report(documents: DataFrame) -> DataFrame:
    """The digest per document; the texts themselves are not staged."""
    stats = _with_vector(documents.select("doc_id", "text", "lang", "source"), "text", "lang", "source").drop("text")
    out = _verdicts(stage(stats, "quality-statistics"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
                      "distance")
