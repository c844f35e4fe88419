"""Quality rules: robust multivariate outliers.

Each text gets a vector of transformed statistics. For every language and source a minimum-covariance-determinant estimate of
the vectors' centre and spread is found by concentration steps over all rows: each step keeps the part of the rows that lie
closest by Mahalanobis distance and takes their mean and covariance, which never raises the determinant; steps end when it falls
no more. Two starts are taken (medians with quartile ranges; the same medians with the covariance of signs), and the one that
ends at the least determinant is the estimate. A step is one aggregation by group, start and distance bin, with partial sums
before the shuffle, so a group that holds a third of all rows costs no task more than its share.

A statistic of a short text scatters more than that of a long one. So a text's distance is taken under its group's covariance
plus the sampling variance that its own length gives each statistic, and texts beyond a quantile of the chi-squared law go.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .store import as_bytes, forget, left_join_small, without, written
from .words import scan, spaced

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_marks")
SYMBOLS = b"#*$%&|<>"
WINDOW = 8

_is_symbol = np.zeros(256, bool)
_is_symbol[list(SYMBOLS)] = True
_is_mark = np.zeros(256, bool)
_is_mark[[b for b in range(0x21, 0x7F) if not chr(b).isalnum() and b not in SYMBOLS]] = True
_is_upper = np.zeros(256, bool)
_is_upper[65:91] = True

#: The vector, of the counts.
VECTOR = ("z_length", "z_symbols", "z_upper", "z_marks", "z_repeats", "z_lines")
_D = len(VECTOR)
#: Added to variances, so that a statistic that never varies in a group has an inverse.
_RIDGE = 1e-6


def _count(column: pa.Array) -> list[np.ndarray]:
    out: list[list[np.ndarray]] = [[] for _ in COUNTS]
    rule = spaced()
    for c in scan(column, rule):
        inside = ~rule.separator[c.data]
        total = np.zeros(len(c.data) + 1, np.int64)

        def per_text(mask: np.ndarray, total=total, c=c) -> np.ndarray:
            np.cumsum(mask, out=total[1:])
            return np.diff(total[c.offsets])

        at, h = c.windows(WINDOW)
        covered = np.zeros(len(c.hash) + 1, np.int64)
        if len(at):
            key = h + c.doc[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            order = np.argsort(key)
            same = key[order][1:] == key[order][:-1]
            twice = np.zeros(len(at), bool)
            twice[order[1:][same]] = True
            twice[order[:-1][same]] = True
            np.add.at(covered, at[twice], 1)
            np.add.at(covered, at[twice] + WINDOW, -1)
        repeated = c.doc[np.cumsum(covered)[:-1] > 0]
        lines, dup = np.zeros(c.n_docs, np.int64), np.zeros(c.n_docs, np.int64)
        for k in range(c.n_docs):
            own = [x for x in c.text(k).split(b"\n") if x.strip()]
            lines[k], dup[k] = len(own), len(own) - len(set(own))
        values = (
            c.n_words, per_text(inside & ((c.data & 0xC0) != 0x80)), per_text(_is_symbol[c.data]), dup, np.bincount(repeated, minlength=c.n_docs), lines, per_text(_is_upper[c.data]), per_text(_is_mark[c.data]),
        )
        for x, v in zip(out, values, strict=True):
            x.append(v)
    return [np.concatenate(x) if x else np.zeros(0, np.int64) for x in out]


def vectors(counts: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """For each text the vector of VECTOR, and the sampling variance of each of its statistics. The square root of a share has a
    variance of 1 / (4 n); the logarithm of a mean that of the mean over its square (word lengths have a squared coefficient of
    variation of about 0.3); repeated words come in two runs of WINDOW at least, so n of them are worth n / (2 WINDOW)."""
    n = {k: np.maximum(v, 1).astype(np.float64) for k, v in counts.items()}
    share = lambda part, whole: np.sqrt(counts[part] / n[whole])
    z = (np.log(n["word_chars"] / n["n_words"]), share("n_symbols", "word_chars"), share("n_upper", "word_chars"), share("n_marks", "word_chars"), share("n_repeat_words", "n_words"), share("n_dup_lines", "n_lines"))
    chars = 0.25 / n["word_chars"]
    return np.stack(z, 1), np.stack((0.3 / n["n_words"], chars, chars, chars, 0.25 * 2 * WINDOW / n["n_words"], 0.25 / n["n_lines"]), 1)


def _distances(counts: dict[str, np.ndarray], centre: pa.Array, spread: pa.Array) -> pa.Array:
    """The squared Mahalanobis distance of each text; null where there is no estimate."""
    known = np.flatnonzero(centre.is_valid().to_numpy(zero_copy_only=False))
    out = np.full(len(centre), np.nan)
    if len(known):
        z, noise = vectors({k: v[known] for k, v in counts.items()})
        flat = lambda x: x.take(pa.array(known)).flatten().to_numpy(zero_copy_only=False)
        off = z - flat(centre).reshape(-1, _D)
        cov = flat(spread).reshape(-1, _D, _D).copy()
        cov[:, range(_D), range(_D)] += noise
        out[known] = np.einsum("ij,ij->i", off, np.linalg.solve(cov, off[..., None])[..., 0])
    return pa.array(out, pa.float64(), mask=np.isnan(out))


_MEASURES = [*(T.StructField(x, T.LongType()) for x in COUNTS), *(T.StructField(z, T.DoubleType()) for z in VECTOR)]


def _measured(counts: dict[str, np.ndarray]) -> list[pa.Array]:
    return [*(pa.array(counts[x], pa.int64()) for x in COUNTS), *(pa.array(np.ascontiguousarray(z), pa.float64()) for z in vectors(counts)[0].T)]


def statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs (without the text) with the counts of COUNTS (long) and the vector of VECTOR (double) for each whole text. A null or
    empty text has zeros; rows are counted each on their own, so ties and repeated rows change nothing; columns whose names
    clash are replaced. Only the texts go to Python."""

    @F.arrow_udf(T.StructType(_MEASURES))
    def counted(column):
        return pa.StructArray.from_arrays(_measured(dict(zip(COUNTS, _count(column), strict=True))), names=[f.name for f in _MEASURES])

    rows = without(docs, *(c for c in (*COUNTS, *VECTOR) if c != text), "_found")
    # a text is counted once, wherever the counts are used
    rows = rows.withColumn("_found", counted.asNondeterministic()(as_bytes(text)))
    return rows.select(*(c for c in rows.columns if c not in ("_found", text)), "_found.*")


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def chi_squared(quantile: float, d: int) -> float:
    """The quantile of the chi-squared law with d degrees of freedom, by bisection."""
    low, high = 0.0, 1000.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if _chi_squared_below(mid, d) < quantile else (low, mid)
    return high


def _chi_squared_below(x: float, d: int) -> float:
    """P(chi-squared <= x), by the series of the incomplete gamma function."""
    if x <= 0:
        return 0.0
    a, z = d / 2, x / 2
    term = total = 1 / a
    n = a
    while term > total * 1e-17:
        n += 1
        term *= z / n
        total += term
    return min(1.0, total * math.exp(-z + a * math.log(z) - math.lgamma(a)))


def estimates(counts: DataFrame, lang: str = "lang", source: str = "source", part: float = 0.75, min_group: int = 60, steps: int = 60) -> DataFrame:
    """The estimate of each language and source in counts (from statistics()): _l, _s, centre and spread (the covariance, row by
    row).

    Nulls are a value of their own. An estimate of six statistics needs ten rows for each: the rows of groups under min_group
    are pooled by language, and pools still under it are pooled together; if that is under it too, its groups are left out.
    Rows that base_failed have no say. Should a determinant still fall after so many steps, that is an error.
    """
    z = list(VECTOR)
    fit = counts.where(~base_failed()).select(F.col(lang).alias("_l"), F.col(source).alias("_s"), *z)
    size = fit.groupBy("_l", "_s").agg(F.count("*").alias("_n"))
    pool = size.where(F.col("_n") < min_group).groupBy(F.col("_l").alias("_pl")).agg(F.sum("_n").alias("_pn"))
    group = F.when(F.col("_n") >= min_group, F.to_json(F.array("_l", "_s"))).when(F.col("_pn") >= min_group, F.to_json(F.array("_l"))).otherwise("[]")
    names = written(size.join(pool, F.col("_l").eqNullSafe(F.col("_pl")), "left").select("_l", "_s", group.alias("grp")), "groups")
    of = names.select(F.col("_l").alias("_gl"), F.col("_s").alias("_gs"), "grp")
    fit = written(fit.join(of, F.col("_l").eqNullSafe(F.col("_gl")) & F.col("_s").eqNullSafe(F.col("_gs"))).select("grp", *z), "vectors")
    quartiles = [F.percentile(F.round(x, 3), F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias(x) for x in z]
    middle = written(fit.groupBy("grp").agg(F.count("*").alias("n"), *quartiles).where(F.col("n") >= min_group), "quartiles")
    wide = [F.greatest((F.col(x)[2] - F.col(x)[0]) / 1.349, F.lit(math.sqrt(_RIDGE))) for x in z]
    centre = F.array(*(F.col(x)[1] for x in z))
    ranges = F.array(*(wide[i] * wide[i] if i == j else F.lit(0.0) for i in range(_D) for j in range(_D)))
    signs = fit.join(middle.select("grp", *(F.col(x)[1].alias(f"_{x}") for x in z)), "grp").select("grp", *(F.signum(F.col(x) - F.col(f"_{x}")).alias(x) for x in z))
    signs = signs.groupBy("grp").agg(*(F.avg(F.col(z[i]) * F.col(z[j])).alias(f"_{i}_{j}") for i in range(_D) for j in range(_D)))
    signed = F.array(*(wide[i] * wide[j] * (F.col(f"_{i}_{j}") + (0.05 if i == j else 0.0)) for i in range(_D) for j in range(_D)))
    start = middle.join(signs, "grp").select("grp", centre.alias("centre"), F.explode(F.array(*(F.struct(F.lit(k).alias("start"), m.alias("spread")) for k, m in enumerate((ranges, signed))))).alias("s"))
    moving = start.select("grp", "s.start", "centre", "s.spread", F.lit(float("inf")).alias("logdet"), F.lit(False).alias("done"))
    estimate = written(moving.select("grp", "start", "centre", "spread", "logdet", "done").mapInArrow(_rooted, _ESTIMATE), "estimate")
    for _ in range(steps):
        before, still = estimate, estimate.where("not done")
        if still.isEmpty():
            break
        estimate = written(before.where("done").unionByName(_concentrate(fit, still, part)), "estimate")
        forget(before)
    else:
        raise RuntimeError(f"some determinants still fall after {steps} steps")
    best = estimate.groupBy("grp").agg(F.min_by(F.struct("centre", "spread"), F.struct("logdet", "start")).alias("b"))
    out = written(names.join(best, "grp").select("_l", "_s", "b.centre", "b.spread"), "estimates")
    forget(names, fit, middle, estimate)
    return out


def judged(counts: DataFrame, estimate: DataFrame, lang: str = "lang", source: str = "source", alpha: float = 1e-3) -> DataFrame:
    """Rows of statistics() with base_failed, distance (squared Mahalanobis; null without an estimate) and kept: neither
    base_failed nor beyond the chi-squared quantile 1 - alpha. Rows without an estimate are kept unless base_failed."""

    @F.arrow_udf(T.DoubleType())
    def distance(own, centre, spread):
        return _distances({x: own.field(x).to_numpy(zero_copy_only=False) for x in COUNTS}, centre, spread)

    rows = without(counts, *_JUDGED, *_JOINED)
    out = _with_estimate(rows, estimate, lang, source).withColumn("distance", distance(F.struct(*COUNTS), F.col("centre"), F.col("spread")))
    return _verdict(out, alpha).select(*rows.columns, *_JUDGED)


def judged_texts(docs: DataFrame, estimate: DataFrame, lang: str = "lang", source: str = "source", text: str = "text", alpha: float = 1e-3) -> DataFrame:
    """judged(statistics(docs)) with the text, counted and judged in one go."""
    fields = [*_MEASURES, T.StructField("distance", T.DoubleType())]

    @F.arrow_udf(T.StructType(fields))
    def found(column, centre, spread):
        counts = dict(zip(COUNTS, _count(column), strict=True))
        return pa.StructArray.from_arrays([*_measured(counts), _distances(counts, centre, spread)], names=[f.name for f in fields])

    rows = without(docs, *(c for c in (*COUNTS, *VECTOR, *_JUDGED, *_JOINED) if c != text))
    out = _with_estimate(rows, estimate, lang, source).withColumn("_found", found.asNondeterministic()(as_bytes(text), F.col("centre"), F.col("spread")))
    return _verdict(out.select(*rows.columns, "_found.*"), alpha)


_JUDGED = ("base_failed", "distance", "kept")
_JOINED = ("centre", "spread", "_group", "_of", "_found")


def _with_estimate(rows: DataFrame, estimate: DataFrame, lang: str, source: str) -> DataFrame:
    group = lambda a, b: F.to_json(F.array(F.col(a).cast("string"), F.col(b).cast("string")))
    keyed = estimate.select(group("_l", "_s").alias("_of"), "centre", "spread")
    return left_join_small(rows.withColumn("_group", group(lang, source)), keyed, "_group", "_of")


def _verdict(rows: DataFrame, alpha: float) -> DataFrame:
    near = F.coalesce(F.col("distance"), F.lit(0.0)) <= chi_squared(1 - alpha, _D)
    return rows.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & near)


_ESTIMATE = "grp string, start int, centre array<double>, spread array<double>, logdet double, done boolean, root array<double>"


def _root(spread: np.ndarray) -> list[float]:
    """The squared length of root x (vector - centre) is the squared distance."""
    return np.linalg.inv(np.linalg.cholesky(spread)).ravel().tolist()


def _rooted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        roots = [_root(np.array(x).reshape(_D, _D)) for x in batch.column("spread").to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(roots, pa.list_(pa.float64()))], names=[*batch.schema.names, "root"])


def _concentrate(fit: DataFrame, estimate: DataFrame, part: float) -> DataFrame:
    """One concentration step: the rows of the nearest bins, until they are the wanted part, give the next estimate."""
    z, d = VECTOR, _D

    off = [F.col(name) - F.col("centre")[i] for i, name in enumerate(z)]
    rows = [sum((F.col("root")[i * d + j] * off[j] for j in range(i + 1)), F.lit(0.0)) for i in range(d)]
    far = sum((x * x for x in rows), F.lit(0.0))
    known = estimate.select("grp", "start", "centre", "root", F.col("logdet").alias("last"))
    near = fit.join(known, "grp").withColumn("bin", F.floor(64 * F.log2(far + 1e-9)).cast("int"))
    pairs = [(i, j) for i in range(d) for j in range(i + 1)]
    sums = near.groupBy("grp", "start", "bin").agg(
        F.first("last").alias("last"), F.count("*").alias("n"), *(F.sum(x).alias(f"s{i}") for i, x in enumerate(z)), *(F.sum(F.col(z[i]) * F.col(z[j])).alias(f"p{i}_{j}") for i, j in pairs)
    )
    consistent = part / _chi_squared_below(chi_squared(part, d), d + 2)

    def next_estimate(key, bins):
        bins = bins.sort_by("bin")
        get = lambda c: bins.column(c).to_numpy().astype(np.float64)
        n, last = get("n"), get("last")[0]
        upto = int(np.searchsorted(np.cumsum(n), part * n.sum())) + 1
        share = n[:upto].sum()
        mean = np.array([get(f"s{i}")[:upto].sum() for i in range(d)]) / share
        cov = np.zeros((d, d))
        for i, j in pairs:
            cov[i, j] = cov[j, i] = get(f"p{i}_{j}")[:upto].sum() / share - mean[i] * mean[j]
        cov = cov * consistent + np.eye(d) * _RIDGE
        logdet = float(np.linalg.slogdet(cov)[1])
        return pa.table({
            "grp": pa.array([key[0].as_py()], pa.string()), "start": pa.array([key[1].as_py()], pa.int32()), "centre": pa.array([mean.tolist()], pa.list_(pa.float64())),
            "spread": pa.array([cov.ravel().tolist()], pa.list_(pa.float64())), "logdet": pa.array([logdet]), "done": pa.array([bool(logdet >= last - 1e-6)]), "root": pa.array([_root(cov)], pa.list_(pa.float64())),
        })

    return sums.groupBy("grp", "start").applyInArrow(next_estimate, _ESTIMATE)
