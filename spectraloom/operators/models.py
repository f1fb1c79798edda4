"""Models per key, factorization, projections.

Models with factor terms are fitted from design cells (count, sum and sum of
squares per combination of levels), so what a task receives is bounded by the
design, not by the rows of a key.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from spectraloom.functions import distributions as dist
from spectraloom.functions.columns import first_row, ratio
from spectraloom.functions.ordered import exact_quantile, p_adjust_bh
from spectraloom.functions.session import attach, cut, design_levels, spread
from spectraloom.operators.relational import blocked_pairs, column_gram, vector_dot


# --- least squares on cells -----------------------------------------------------

def _term_matrix(cells: pd.DataFrame, term: str) -> tuple[list[str], np.ndarray]:
    """Treatment-coded columns of one term (``a`` or ``a:b``); numbers stay numbers."""
    names, block = [""], np.ones((len(cells), 1))
    for column in term.split(":"):
        v = cells[column]
        if pd.api.types.is_numeric_dtype(v):
            part, labels = v.to_numpy(float)[:, None], [column]
        else:
            levels = sorted(v.dropna().unique())[1:]
            part = np.stack([(v == x).to_numpy(float) for x in levels], axis=1) if levels else np.zeros((len(cells), 0))
            labels = [f"{column}{x}" for x in levels]
        block = (block[:, :, None] * part[:, None, :]).reshape(len(cells), -1)
        names = [f"{a}:{b}" if a else b for a in names for b in labels]
    return names, block


class CellFit:
    """Weighted least squares of cell means with the within-cell spread kept."""

    def __init__(self, cells: pd.DataFrame, terms: list[str], n: str = "_n", s: str = "_s", q: str = "_q", intercept: bool = True):
        w, y = cells[n].to_numpy(float), cells[s].to_numpy(float) / cells[n].to_numpy(float)
        self.within = float((cells[q].to_numpy(float) - w * y * y).sum())
        names, blocks, owner = (["(Intercept)"], [np.ones((len(cells), 1))], [-1]) if intercept else ([], [], [])
        for i, term in enumerate(terms):
            labels, block = _term_matrix(cells, term)
            names += labels
            blocks.append(block)
            owner += [i] * len(labels)
        x = np.hstack(blocks)
        # columns explained by earlier ones are left out, as in sequential fitting
        keep, basis = [], np.zeros((len(cells), 0))
        sw = np.sqrt(w)
        for j in range(x.shape[1]):
            col = x[:, j] * sw
            rest = col - basis @ (basis.T @ col)
            rest = rest - basis @ (basis.T @ rest)
            if np.linalg.norm(rest) > 1e-7 * max(np.linalg.norm(col), 1e-300):
                keep.append(j)
                basis = np.hstack([basis, (rest / np.linalg.norm(rest))[:, None]])
        self.names, self.owner = [names[j] for j in keep], [owner[j] for j in keep]
        aliased = [names[j] for j in range(len(names)) if j not in keep]
        self.x, self.terms = x[:, keep], terms
        xs = self.x * sw[:, None]
        self.xtx_inv = np.linalg.pinv(xs.T @ xs)
        self.beta = self.xtx_inv @ (xs.T @ (y * sw))
        self.fitted = self.x @ self.beta
        self.rss = self.within + float((w * (y - self.fitted) ** 2).sum())
        self.df = float(w.sum()) - len(keep)
        told = [f"left out: {', '.join(aliased)}"] if aliased else []
        self.warning = "; ".join(told + (["no residual degrees of freedom"] if self.df <= 0 else [])) or None
        self.effects = (basis.T @ (y * sw)) ** 2
        self.sigma2 = self.rss / self.df if self.df > 0 else np.nan

    def coefficients(self) -> pd.DataFrame:
        se = np.sqrt(np.maximum(np.diag(self.xtx_inv) * self.sigma2, 0))
        with np.errstate(all="ignore"):
            t = self.beta / se
        p = 2 * dist.t_upper(np.abs(t), np.full_like(t, self.df)) if self.df > 0 else np.full_like(t, np.nan)
        return pd.DataFrame({"term": self.names, "estimate": self.beta, "SE": se, "df": self.df, "stat": t, "p": p})

    def anova(self) -> pd.DataFrame:
        rows = []
        for i, term in enumerate(self.terms):
            mine = [k for k, o in enumerate(self.owner) if o == i]
            if not mine:
                continue
            ss = float(self.effects[mine].sum())
            f = ss / len(mine) / self.sigma2 if self.sigma2 and self.sigma2 > 0 else np.nan
            p = float(dist.f_upper(np.array([f]), np.array([float(len(mine))]), np.array([self.df]))[0]) if self.df > 0 else np.nan
            rows.append((term, ss, np.nan, float(len(mine)), f, p))
        rows.append(("Residuals", self.rss, np.nan, self.df, np.nan, np.nan))
        return pd.DataFrame(rows, columns=["term", "estimate", "SE", "df", "stat", "p"])

    def combination(self, a: np.ndarray) -> tuple[float, float]:
        return float(a @ self.beta), float(np.sqrt(max(a @ self.xtx_inv @ a * self.sigma2, 0)))


def stars(p: Column) -> Column:
    return F.when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").when(p < 0.1, ".").otherwise("")


def design_cells(df: DataFrame, keys: list[str], columns: list[str], y: str) -> DataFrame:
    v = F.col(y).cast("double")
    return df.where(F.col(y).isNotNull()).groupBy(*keys, *columns).agg(F.count(F.lit(1)).alias("_n"), F.sum(v).alias("_s"), F.sum(v * v).alias("_q"))


MODEL_SCHEMA = "model string, kind string, term string, estimate double, SE double, df double, stat double, p double, warning string, error string"


def linear_models(df: DataFrame, key: str, y: str, models: dict[str, list[str]], means_of: str | None = None, post=None, second_order: bool = False) -> DataFrame:
    """Per key and model: coefficients, sequential anova, marginal means and contrasts, error text.

    ``models`` maps a name to its terms, such as ``["GROUP", "SUBJECT"]`` or
    ``["a", "b", "a:b"]``. ``means_of`` names a factor whose marginal means and
    pairwise differences are added (kinds ``mean`` and ``contrast``), with
    ``second_order`` also the differences of those (``contrast2``). ``post``
    may turn a fit into more (term, estimate, SE, df, stat, p) rows. Anova rows
    carry ``stars``; ``warning`` names columns that others explain and a fit
    without residual degrees of freedom.
    """
    columns = list(dict.fromkeys(c for terms in models.values() for t in terms for c in t.split(":")))
    cells = design_cells(df, [key], columns, y)
    key_type = df.schema[key].dataType.simpleString()

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for name, terms in models.items():
            try:
                f = CellFit(pdf, terms)
                tables = {"coef": f.coefficients(), "anova": f.anova()}
                if means_of is not None:
                    tables.update(_marginal(f, pdf, terms, means_of, second_order))
                if post is not None:
                    tables["post"] = post(f, pdf)
                out += [t.assign(kind=k, model=name, warning=f.warning, error=None) for k, t in tables.items()]
            except Exception as e:  # noqa: BLE001
                out.append(pd.DataFrame([{"model": name, "kind": "error", "error": str(e)}]))
        full = pd.concat(out, ignore_index=True).reindex(columns=["model", "kind", "term", "estimate", "SE", "df", "stat", "p", "warning", "error"])
        full.insert(0, key, pdf[key].iloc[0])
        return full

    fitted = spread(cells, key).groupBy(key).applyInPandas(fit, f"`{key}` {key_type}, {MODEL_SCHEMA}")
    return fitted.withColumn("stars", F.when((F.col("kind") == "anova") & F.col("p").isNotNull() & ~F.isnan("p"), stars(F.col("p"))))


def _marginal(f: CellFit, cells: pd.DataFrame, terms: list[str], factor: str, second_order: bool = False) -> dict[str, pd.DataFrame]:
    columns = list(dict.fromkeys(c for t in terms for c in t.split(":")))
    others = [c for c in columns if c != factor]
    choices = [sorted(cells[c].dropna().unique()) if not pd.api.types.is_numeric_dtype(cells[c]) else [cells[c].mean()] for c in others]
    levels = sorted(cells[factor].dropna().unique())
    grid = pd.MultiIndex.from_product([levels, *choices], names=[factor, *others]).to_frame(index=False)
    both = pd.concat([cells[[factor, *others]], grid], ignore_index=True)
    names, blocks = ["(Intercept)"], [np.ones((len(both), 1))]
    for t in terms:
        labels, block = _term_matrix(both, t)
        names += labels
        blocks.append(block)
    x = np.hstack(blocks)[len(cells) :][:, [names.index(n) for n in f.names]]
    rows = {lv: x[(grid[factor] == lv).to_numpy()].mean(axis=0) for lv in levels}

    def line(label, a):
        est, se = f.combination(a)
        t = est / se if se > 0 else np.nan
        p = float(2 * dist.t_upper(np.array([abs(t)]), np.array([f.df]))[0]) if f.df > 0 else np.nan
        return label, est, se, f.df, t, p

    cols = ["term", "estimate", "SE", "df", "stat", "p"]
    means = pd.DataFrame([line(str(lv), a) for lv, a in rows.items()], columns=cols)
    vectors = [(f"{a}-{b}", rows[a] - rows[b]) for i, a in enumerate(levels) for b in levels[i + 1 :]]
    out = {"mean": means, "contrast": pd.DataFrame([line(*v) for v in vectors], columns=cols)}
    if second_order:
        out["contrast2"] = pd.DataFrame([line(f"{a} - {b}", u - v) for i, (a, u) in enumerate(vectors) for b, v in vectors[i + 1 :]], columns=cols)
    return out


def contrasts_vs_control(models: DataFrame, control: str) -> DataFrame:
    """Pairwise contrasts that involve the control level, control second."""
    d = models.where(F.col("kind") == "contrast")
    left, right = F.split("term", "-")[0], F.split("term", "-")[1]
    d = d.where((left == control) | (right == control))
    flip = left == control
    sign = F.when(flip, -1.0).otherwise(1.0)
    return d.withColumns({"term": F.when(flip, F.concat_ws("-", right, left)).otherwise(F.col("term")), "estimate": F.col("estimate") * sign, "stat": F.col("stat") * sign})


def contrast_of_contrasts(df: DataFrame, key: str, y: str, models: dict[str, list[str]], means_of: str) -> DataFrame:
    """Differences of pairwise contrasts inside each key and model, with standard error, t and p."""
    return linear_models(df, key, y, models, means_of, second_order=True).where(F.col("kind") == "contrast2")


def one_factor_means(df: DataFrame, keys: list[str], group: str, y: str) -> DataFrame:
    """Pairwise differences of a one-factor model straight from group n, mean and variance."""
    g = df.where(F.col(y).isNotNull()).groupBy(*keys, group).agg(F.count(F.lit(1)).alias("n"), F.avg(y).alias("m"), F.coalesce(F.var_samp(y), F.lit(0.0)).alias("v"))
    pool = g.groupBy(*keys).agg(F.sum((F.col("n") - 1) * F.col("v")).alias("rss"), (F.sum("n") - F.count(F.lit(1))).alias("df"))
    b = g.select(*keys, F.col(group).alias("g2"), F.col("n").alias("n2"), F.col("m").alias("m2"))
    d = g.join(b, keys).where(F.col(group) < F.col("g2")).join(pool, keys)
    se = F.sqrt(ratio(F.col("rss"), F.col("df")) * (1 / F.col("n") + 1 / F.col("n2")))
    d = d.withColumn("estimate", F.col("m") - F.col("m2")).withColumn("SE", se).withColumn("t", ratio(F.col("estimate"), F.col("SE")))
    return d.select(*keys, F.concat_ws("-", group, "g2").alias("contrast"), "estimate", "SE", F.col("df").cast("bigint").alias("df"), "t", (2 * dist.t_tail(F.abs("t"), F.col("df").cast("double"))).alias("p"))


def fitted_values(df: DataFrame, key: str, y: str, terms: list[str], grid: bool = False) -> DataFrame:
    """Fitted value of each design cell of a key; with ``grid``, of every combination of levels."""
    columns = list(dict.fromkeys(c for t in terms for c in t.split(":")))
    cells = design_cells(df, [key], columns, y)
    fields = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in [key, *columns])

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        f = CellFit(pdf, terms)
        if not grid:
            return pdf[[key, *columns]].assign(fitted=f.fitted)
        g = pd.MultiIndex.from_product([sorted(pdf[c].unique()) for c in columns], names=columns).to_frame(index=False)
        both = pd.concat([pdf[columns], g], ignore_index=True)
        names, blocks = ["(Intercept)"], [np.ones((len(both), 1))]
        for t in terms:
            labels, block = _term_matrix(both, t)
            names += labels
            blocks.append(block)
        x = np.hstack(blocks)[len(pdf) :][:, [names.index(n) for n in f.names]]
        g.insert(0, key, pdf[key].iloc[0])
        return g[[key, *columns]].assign(fitted=x @ f.beta)

    return spread(cells, key).groupBy(key).applyInPandas(fit, f"{fields}, fitted double")


def group_means_and_residuals(df: DataFrame, key: str, y: str, group: str, terms: list[str]) -> DataFrame:
    """Marginal mean of each row's group plus the row's residual."""
    columns = list(dict.fromkeys(c for t in terms for c in t.split(":")))
    means = linear_models(df, key, y, {"m": terms}, group).where(F.col("kind") == "mean").select(key, F.col("term").alias(group), F.col("estimate").alias("groupMean"))
    d = df.where(F.col(y).isNotNull()).join(fitted_values(df, key, y, terms), [key, *columns]).join(means, [key, group])
    return d.withColumn("residual", F.col(y) - F.col("fitted")).withColumn("groupMeanPlusResidual", F.col("groupMean") + F.col("residual")).drop("fitted")


def predictions_over_grid(df: DataFrame, key: str, y: str, terms: list[str]) -> DataFrame:
    columns = list(dict.fromkeys(c for t in terms for c in t.split(":")))
    grid = fitted_values(df, key, y, terms, grid=True)
    actual = df.groupBy(key, *columns).agg(F.avg(y).alias("actual"))
    return grid.join(actual, [key, *columns], "left")


# --- polynomials over time ------------------------------------------------------

POLY_SCHEMA = "power int, pOverall double, pIncrement double, df double, best int, largestDelta double, startTime double, coefficients array<double>, predictions array<struct<time: double, value: double>>, error string"


def fit_polynomial_powers(
    df: DataFrame, key: str, time: str = "rankTime", subject: str = "SUBJECT", y: str = "LogIntensities", max_power: int = 3, min_power: int = 3,
    p_overall: float = 0.01, p_increment: float = 0.05, start_times: tuple[float, ...] = (0.0,),
) -> DataFrame:
    """Powers 0..max of time with a subject term, F tests and the chosen power per key.

    The best power is the largest allowed one passing both tests, else
    ``min_power``. Predictions are averaged over subjects at each time.
    """
    cells = design_cells(df, [key], [time, subject], y)
    key_type = df.schema[key].dataType.simpleString()

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = []
        try:
            c = pdf.copy()
            c[subject] = c[subject].astype(str)
            times = np.sort(c[time].astype(float).unique())
            top = min(max_power, len(times) - 1)
            if top < 1:
                raise ValueError("too few time points")
            fits = []
            for power in range(top + 1):
                for k in range(1, power + 1):
                    c[f"t{k}"] = c[time].astype(float) ** k
                fits.append(CellFit(c, [subject, *[f"t{k}" for k in range(1, power + 1)]]))
            tests = {}
            for power in range(1, top + 1):
                f = fits[power]
                if f.df <= 0:
                    raise ValueError("too few data")
                against = []
                for base in (fits[0], fits[power - 1]):
                    extra = base.df - f.df
                    stat = max((base.rss - f.rss) / extra / f.sigma2, 0.0) if extra > 0 and f.sigma2 > 0 else np.nan
                    against.append(float(dist.f_upper(np.array([stat]), np.array([float(extra)]), np.array([f.df]))[0]))
                tests[power] = against
            passing = [p for p, (a, b) in tests.items() if min_power <= p and a < p_overall and b < p_increment]
            best = max(passing) if passing else min(top, max(min_power, 1))
            for power in range(1, top + 1):
                f = fits[power]
                poly = {n: b for n, b in zip(f.names, f.beta)}
                base = poly["(Intercept)"] + sum(b for n, b in poly.items() if n.startswith(subject)) / c[subject].nunique()
                coef = [base] + [poly.get(f"t{k}", 0.0) for k in range(1, power + 1)]
                pred = sum(b * times**k for k, b in enumerate(coef))
                delta = {s: pred - sum(b * s**k for k, b in enumerate(coef)) for s in start_times}
                start = max(delta, key=lambda s: np.abs(delta[s]).max())
                d = delta[start][np.abs(delta[start]).argmax()]
                rows.append((power, *tests[power], f.df, best, float(d), float(start), coef, [{"time": a, "value": b} for a, b in zip(times, pred)], None))
        except Exception as e:  # noqa: BLE001
            rows = [(None, None, None, None, None, None, None, None, None, str(e))]
        out = pd.DataFrame(rows, columns=["power", "pOverall", "pIncrement", "df", "best", "largestDelta", "startTime", "coefficients", "predictions", "error"])
        out["power"], out["best"] = out["power"].astype("Int32"), out["best"].astype("Int32")
        out.insert(0, key, pdf[key].iloc[0])
        return out

    return spread(cells, key).groupBy(key).applyInPandas(fit, f"`{key}` {key_type}, {POLY_SCHEMA}")


def poly_fits_table(fits: DataFrame, key: str) -> DataFrame:
    """Chosen power per key with its adjusted overall p."""
    d = cut(fits.where(F.col("power") == F.col("best")).select(key, "power", "pOverall", "pIncrement", "largestDelta", "startTime", "predictions"))
    return p_adjust_bh(d, "pOverall", "adjP")


def poly_actual_matrix(df: DataFrame, key: str, time: str, y: str, vs_first: bool = True) -> DataFrame:
    """Mean value per time, minus the first time that has one."""
    m = df.groupBy(key, time).agg(F.avg(y).alias("value"))
    if not vs_first:
        return m
    first = m.where(F.col("value").isNotNull()).groupBy(key).agg(F.min_by("value", time).alias("_f"))
    return m.join(first, key, "left").withColumn("value", F.col("value") - F.col("_f")).drop("_f")


def detrended_fits(actual: DataFrame, predicted: DataFrame, info: DataFrame, column: str = "column") -> DataFrame:
    """Polynomial fits of log2(actual / predicted) per receptor and gene, BH inside each receptor.

    Both tables are long (``gene, column, value``); ``info`` gives ``receptor,
    rankTime, SUBJECT`` per column. Genes given twice are left out.
    """
    a = actual.groupBy("gene", column).agg(F.first("value").alias("_a"), F.count(F.lit(1)).alias("_n")).where(F.col("_n") == 1)
    d = a.join(predicted.select("gene", column, F.col("value").alias("_p")), ["gene", column]).where((F.col("_a") > 0) & (F.col("_p") > 0))
    d = d.join(info, column).withColumn("log2Ratio", F.log2(F.col("_a") / F.col("_p"))).withColumn("_key", F.concat_ws("\u0001", "receptor", "gene"))
    f = fit_polynomial_powers(d, "_key", y="log2Ratio").where(F.col("power") == F.col("best"))
    part = F.split("_key", "\u0001")
    f = f.select(part[0].alias("receptor"), part[1].alias("gene"), "power", "pOverall", "largestDelta")
    return p_adjust_bh(f, "pOverall", "adjP", ["receptor"])


# --- location fits --------------------------------------------------------------

def _nnls(g: np.ndarray, b: np.ndarray, rounds: int = 2000) -> np.ndarray:
    """Non-negative solution of ``min w G w / 2 - b w`` for every row of b, by coordinate descent."""
    w = np.zeros_like(b)
    diag = np.maximum(np.diag(g), 1e-12)
    for _ in range(rounds):
        change = 0.0
        for j in range(g.shape[0]):
            new = np.maximum(0.0, w[:, j] + (b[:, j] - w @ g[:, j]) / diag[j])
            change = max(change, float(np.abs(new - w[:, j]).max(initial=0.0)))
            w[:, j] = new
        if change < 1e-12:
            break
    return w


def location_fit(
    samples: DataFrame, references: DataFrame, row: str, run: str, value: str, location: str = "location", nonneg: bool = True, decoys: int = 0, iterations: int = 1, seed: int = 1
) -> DataFrame:
    """Each run as a mix of reference columns: ``run, location, coefficient, rss``.

    Normal equations come from one aggregate over the long tables; only k x k
    systems are solved per run. With ``decoys``, shuffled reference columns join
    each iteration and the median over iterations is kept.
    """
    refs = references.select(row, F.col(location).alias("loc"), F.col("value").alias("x"))
    if decoys:
        names = refs.select(F.lit(1).alias("_one"), "loc").distinct()
        extra = refs.join(names.select("loc").distinct(), "loc").withColumn("it", F.explode(F.sequence(F.lit(1), F.lit(iterations))))
        extra = extra.withColumn("d", F.explode(F.sequence(F.lit(1), F.lit(decoys))))
        # a decoy column takes each row's value from a location drawn by hash
        pick = extra.groupBy(row, "it", "d").agg(F.min_by("x", F.xxhash64(row, "it", "d", "loc", F.lit(seed))).alias("x"))
        every = refs.withColumn("it", F.explode(F.sequence(F.lit(1), F.lit(iterations)))).unionByName(pick.select(row, "it", F.concat(F.lit("decoy"), F.col("d").cast("string")).alias("loc"), "x"))
    else:
        every = refs.withColumn("it", F.lit(1))
    per_row = every.groupBy(row, "it").agg(F.array_sort(F.collect_list(F.struct("loc", "x"))).alias("r"))
    j = samples.where(F.col(value).isNotNull()).select(row, F.col(run).alias("run"), F.col(value).alias("y")).join(per_row, row)
    a = j.select("run", "it", "y", "r", F.explode("r").alias("a"))
    xy = a.groupBy("run", "it", F.col("a.loc").alias("la")).agg(F.sum(F.col("a.x") * F.col("y")).alias("xy"), F.sum(F.col("y") * F.col("y")).alias("yy"))
    xx = a.select("run", "it", "a", F.explode("r").alias("b")).groupBy("run", "it", F.col("a.loc").alias("la"), F.col("b.loc").alias("lb")).agg(F.sum(F.col("a.x") * F.col("b.x")).alias("xx"))
    eq = xx.join(xy, ["run", "it", "la"])

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        locs = sorted(pdf["la"].unique())
        g = pdf.pivot(index="la", columns="lb", values="xx").reindex(index=locs, columns=locs).fillna(0.0).to_numpy()
        first = pdf.drop_duplicates("la").set_index("la").loc[locs]
        b = first["xy"].to_numpy()
        w = _nnls(g, b[None, :])[0] if nonneg else np.linalg.lstsq(g, b, rcond=None)[0]
        rss = float(first["yy"].max() - 2 * w @ b + w @ g @ w)
        return pd.DataFrame({"run": pdf["run"].iloc[0], "it": pdf["it"].iloc[0], "location": locs, "coefficient": w, "rss": rss})

    run_type = samples.schema[run].dataType.simpleString()
    out = spread(eq, "run", "it").groupBy("run", "it").applyInPandas(solve, f"run {run_type}, it int, location string, coefficient double, rss double")
    return out.groupBy("run", "location").agg(F.median("coefficient").alias("coefficient"), F.median("rss").alias("rss"))


def location_residuals(samples: DataFrame, references: DataFrame, fits: DataFrame, row: str, run: str, value: str) -> DataFrame:
    f = references.select(row, F.col("location"), F.col("value").alias("_x")).join(fits.select("run", "location", "coefficient"), "location")
    f = f.groupBy(row, "run").agg(F.sum(F.col("_x") * F.col("coefficient")).alias("fitted"))
    return samples.withColumnRenamed(run, "run").join(f, [row, "run"]).withColumn("residual", F.col(value) - F.col("fitted"))


def location_matrix(contrasts: DataFrame, quant: DataFrame, base_group: str) -> DataFrame:
    """Linear location profile of each protein: base intensity plus fold change, as a share of its largest."""
    base = quant.where(F.col("GROUP_ORIGINAL") == base_group).groupBy("Protein").agg(F.avg("LogIntensities").alias("_b"))
    d = contrasts.join(base, "Protein").groupBy("Protein", "location").agg(F.avg(F.col("_b") + F.col("log2FC")).alias("_l"))
    d = base.select("Protein", F.lit(base_group).alias("location"), F.col("_b").alias("_l")).unionByName(d)
    top = d.groupBy("Protein").agg(F.max("_l").alias("_t"))
    return d.join(top, "Protein").select("Protein", "location", F.pow(F.lit(2.0), F.col("_l") - F.col("_t")).alias("value"))


def specific_proteins(results: DataFrame, n_equal: int = 0, fc: float = 1.0, p: float = 0.005, similar: dict[str, list[str]] | None = None) -> DataFrame:
    """Proteins higher in one location than in all (minus ``n_equal``) dissimilar others."""
    part = F.split("Label", "-")
    one = results.select("Protein", part[0].alias("location"), part[1].alias("other"), "log2FC", "pvalue")
    d = one.unionByName(one.select("Protein", F.col("other").alias("location"), F.col("location").alias("other"), (-F.col("log2FC")).alias("log2FC"), "pvalue"))
    for loc, close in (similar or {}).items():
        d = d.where(~((F.col("location") == loc) & F.col("other").isin(close)))
    need = d.groupBy("location").agg(F.countDistinct("other").alias("_need"))
    hit = d.where((F.col("log2FC") > fc) & (F.col("pvalue") < p)).groupBy("Protein", "location").agg(F.countDistinct("other").alias("nPassing"))
    return hit.join(need, "location").where(F.col("nPassing") >= F.col("_need") - n_equal).select("Protein", "location", "nPassing")


def proteins_to_fit(df: DataFrame, groups: list[str], min_log: float = 21.0, min_replicates: int = 3) -> DataFrame:
    d = df.where(F.col("GROUP_ORIGINAL").isin(groups) & (F.col("LogIntensities") > min_log))
    return d.groupBy("Protein", "GROUP_ORIGINAL").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_replicates).select("Protein").distinct()


def proteins_to_fit_by_features(features: DataFrame, groups: list[str], min_replicates: int = 3, quantile: float = 0.75) -> DataFrame:
    """Proteins whose feature count reaches its quantile in enough replicates of one group."""
    n = cut(features.where(F.col("GROUP_ORIGINAL").isin(groups)).groupBy("Protein", "GROUP_ORIGINAL", "RUN").agg(F.countDistinct("FEATURE").alias("n")))
    limit = exact_quantile(n, [], "n", quantile, "_q", stable=True)
    ok = attach(n, limit).where(F.col("n") >= F.col("_q")).groupBy("Protein", "GROUP_ORIGINAL").agg(F.count(F.lit(1)).alias("r"))
    return ok.where(F.col("r") >= min_replicates).select("Protein").distinct()


def composite_backgrounds(run_level: DataFrame, coefficients: DataFrame) -> DataFrame:
    """Mixed background runs: coefficient-weighted linear references per replicate, added to the run-level table.

    ``coefficients`` has ``name, location, coefficient``.
    """
    ref = run_level.where(F.col("LogIntensities").isNotNull()).withColumn("rep", F.split("SUBJECT_ORIGINAL", r"\.")[1])
    j = ref.join(coefficients, ref["GROUP_ORIGINAL"] == coefficients["location"])
    mix = j.groupBy("Protein", "name", "rep").agg(F.sum(F.col("coefficient") * F.pow(F.lit(2.0), "LogIntensities")).alias("_v"))
    mix = mix.select("Protein", F.col("name").alias("GROUP_ORIGINAL"), F.concat_ws(".", "name", "rep").alias("SUBJECT_ORIGINAL"), F.concat_ws("_", "name", "rep").alias("RUN"), F.when(F.col("_v") > 0, F.log2("_v")).alias("LogIntensities"))
    return run_level.select(*mix.columns).unionByName(mix)


# --- factorization, projection, clusters ----------------------------------------

def factorize_nonnegative(
    df: DataFrame, row: str, column: str, value: str, k: int, rounds: int = 50, seed: int = 1, fixed: DataFrame | None = None, restarts: int = 1
) -> tuple[DataFrame, DataFrame]:
    """Least-squares non-negative factors: (basis ``row, factor, w``; coefficients ``factor, col, h``).

    Rows are distributed, one array each; the coefficients (k x design columns)
    are small. A round solves every row against the coefficients where it lies
    and returns only k x k and k x columns sums. ``fixed`` gives one more
    coefficient row (``col, h``) that never changes.
    """
    levels = design_levels(df, column)
    if levels is None:
        raise ValueError(f"{column} is not a design factor")
    position = {lv: i for i, lv in enumerate(levels)}
    v = len(levels)
    dtype = df.schema[column].dataType.simpleString()
    index = F.map_from_arrays(F.array(*[F.lit(lv).cast(dtype) for lv in levels]), F.array(*[F.lit(i) for i in range(v)]))
    rows = cut(df.groupBy(row).agg(F.array_sort(F.collect_list(F.struct(index[F.col(column)].alias("i"), F.col(value).cast("double").alias("x")))).alias("a")))
    base = None
    if fixed is not None:
        base = np.zeros((1, v))
        for r in fixed.collect():
            base[0, position[r["col"]]] = r["h"]

    def dense(arrays) -> np.ndarray:
        m = np.zeros((len(arrays), v))
        for i, a in enumerate(arrays):
            for c in a:
                m[i, c["i"]] = c["x"]
        return m

    best = None
    for attempt in range(restarts):
        rng = np.random.default_rng(seed + attempt)
        h = rng.random((k, v)) + 0.1
        h = np.vstack([h, base]) if base is not None else h
        last = None
        for _ in range(rounds):
            hh = h.copy()

            def sums(batches, hh=hh):
                wtw, wtx, res = np.zeros((len(hh), len(hh))), np.zeros((len(hh), v)), 0.0
                for pdf in batches:
                    x = dense(pdf["a"])
                    w = _nnls(hh @ hh.T, x @ hh.T, 200)
                    wtw += w.T @ w
                    wtx += w.T @ x
                    res += float(((x - w @ hh) ** 2).sum())
                yield pd.DataFrame({"wtw": [wtw.ravel().tolist()], "wtx": [wtx.ravel().tolist()], "res": [res]})

            parts = rows.select("a").mapInPandas(sums, "wtw array<double>, wtx array<double>, res double").toPandas()
            wtw = np.sum([np.array(p) for p in parts["wtw"]], axis=0).reshape(len(h), len(h))
            wtx = np.sum([np.array(p) for p in parts["wtx"]], axis=0).reshape(len(h), v)
            res = float(parts["res"].sum())
            if base is not None:
                wtx_free = wtx[:k] - wtw[:k, k:] @ base
                h = np.vstack([_nnls(wtw[:k, :k], wtx_free.T, 200).T, base])
            else:
                h = _nnls(wtw, wtx.T, 200).T
            if last is not None and abs(last - res) <= 1e-6 * max(last, 1e-12):
                break
            last = res
        if best is None or res < best[0]:
            best = (res, h)
    h = best[1]

    def solve(batches):
        for pdf in batches:
            w = _nnls(h @ h.T, dense(pdf["a"]) @ h.T, 500)
            yield pd.DataFrame({"row": np.repeat(pdf[row].to_numpy(), len(h)), "factor": np.tile(np.arange(len(h)), len(pdf)), "w": w.ravel()})

    row_type = df.schema[row].dataType.simpleString()
    basis = rows.mapInPandas(solve, f"row {row_type}, factor int, w double")
    coef = df.sparkSession.createDataFrame([(i, lv, float(h[i, j])) for i in range(len(h)) for j, lv in enumerate(levels)], f"factor int, col {dtype}, h double")
    return basis, coef


def groups_from_basis(basis: DataFrame, rank: int, share: float = 1.5) -> DataFrame:
    """Best factor of each row when its share is over ``share / rank``."""
    total = basis.groupBy("row").agg(F.sum("w").alias("_t"))
    d = basis.join(total, "row").select("row", "factor", ratio(F.col("w"), F.col("_t")).alias("share"))
    return first_row(d.where(F.col("share").isNotNull()), ["row"], [-F.col("share"), F.col("factor")]).where(F.col("share") > share / rank)


def characterize_bases(basis: DataFrame, rank: int, gmt: DataFrame, **options) -> DataFrame:
    from spectraloom.operators.enrich import enrich_by_group

    g = groups_from_basis(basis, rank)
    universe = basis.select(F.col("row").alias("gene")).distinct()
    return enrich_by_group(g.select(F.concat(F.lit("factor"), F.col("factor").cast("string")).alias("grp"), F.col("row").alias("gene")), gmt, universe, **options)


def factor_residuals(df: DataFrame, row: str, column: str, value: str, basis: DataFrame, coef: DataFrame) -> DataFrame:
    """Long residuals of a factorization, ready for per-row models."""
    fit = basis.withColumnRenamed("row", row).join(coef, "factor").groupBy(row, F.col("col").alias(column)).agg(F.sum(F.col("w") * F.col("h")).alias("_fit"))
    return df.join(fit, [row, column]).withColumn("residual", F.col(value) - F.col("_fit")).drop("_fit")


def pca(df: DataFrame, feature: str, run: str, value: str, components: int = 2) -> DataFrame:
    """Scores of runs on principal components over complete features, with percent of variance.

    Only the runs x runs matrix of products leaves the cluster (a design
    factor); centring each feature across runs is double-centring of it.
    """
    n_runs = df.select(run).distinct().count()
    full = df.where(F.col(value).isNotNull()).groupBy(feature).agg(F.countDistinct(run).alias("_n")).where(F.col("_n") == n_runs)
    sums = column_gram(df.join(full, feature, "left_semi"), [feature], run, value).select("a", "b", "sab").toPandas()
    names = sorted(set(sums["a"]) | set(sums["b"]))
    at = {x: i for i, x in enumerate(names)}
    g = np.zeros((len(names), len(names)))
    for a, b, s in sums.itertuples(index=False):
        g[at[a], at[b]] = g[at[b], at[a]] = s
    c = np.eye(len(names)) - 1.0 / len(names)
    values, vectors = np.linalg.eigh(c @ g @ c)
    order = np.argsort(values)[::-1]
    values, vectors = np.maximum(values[order], 0), vectors[:, order]
    share = 100 * values / values.sum()
    rows = []
    for k in range(min(components, len(names))):
        vec = vectors[:, k] * np.sqrt(values[k])
        vec = vec if vec[np.abs(vec).argmax()] >= 0 else -vec
        rows += [(names[i], k + 1, float(vec[i]), float(share[k])) for i in range(len(names))]
    return df.sparkSession.createDataFrame(rows, T.StructType([T.StructField(run, df.schema[run].dataType), T.StructField("PC", T.IntegerType()), T.StructField("score", T.DoubleType()), T.StructField("percent", T.DoubleType())]))


def kmeans(df: DataFrame, key: str, features: str, k: int, starts: int = 5, rounds: int = 20, seed: int = 1) -> DataFrame:
    """Best of several seeded k-means runs; ``features`` is an array of doubles."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    d = df.select(key, array_to_vector(F.col(features).cast("array<double>")).alias("features"))
    kept = d.persist()
    try:
        models = [KMeans(k=k, maxIter=rounds, seed=seed + i).fit(kept) for i in range(starts)]
        best = min(models, key=lambda m: m.summary.trainingCost)
    finally:
        kept.unpersist()
    return best.transform(d).select(key, F.col("prediction").alias("cluster"))


def unit_vectors(df: DataFrame, key: str, vector: str, center: bool = False) -> DataFrame:
    """``key, vector`` scaled to length one (after centring when asked); zero vectors are dropped."""
    v = F.col(vector).cast("array<double>")
    if center:
        mean = F.aggregate(v, F.lit(0.0), lambda a, x: a + x) / F.size(v)
        d = df.select(key, v.alias("_v"), mean.alias("_m")).select(key, F.transform("_v", lambda x: x - F.col("_m")).alias("_v"))
    else:
        d = df.select(key, v.alias("_v"))
    d = d.withColumn("_n", F.sqrt(F.aggregate("_v", F.lit(0.0), lambda a, x: a + x * x))).where(F.col("_n") > 1e-12)
    return d.select(key, F.transform("_v", lambda x: x / F.col("_n")).alias("vector"))


def cosine_pairs(df: DataFrame, key: str, vector: str, threshold: float | None = None) -> DataFrame:
    """Cosine of every pair of rows ``a < b``, optionally only at or over a threshold."""
    return blocked_pairs(unit_vectors(df, key, vector), [], key, "vector", vector_dot, threshold).withColumnRenamed("score", "cosine")


def cosine_between_samples(df: DataFrame, row: str, sample: str, column: str, value: str, a: str, b: str) -> DataFrame:
    """Cosine of the same row in two samples over a shared column axis; absent cells are zero."""
    v = F.col(value)
    cells = df.where(F.col(sample).isin(a, b)).groupBy(row, column).agg(F.sum(F.when(F.col(sample) == a, v).otherwise(0.0)).alias("x"), F.sum(F.when(F.col(sample) == b, v).otherwise(0.0)).alias("y"))
    d = cells.groupBy(row).agg(F.sum(F.col("x") * F.col("y")).alias("xy"), F.sum(F.col("x") * F.col("x")).alias("xx"), F.sum(F.col("y") * F.col("y")).alias("yy"))
    return d.select(row, ratio(F.col("xy"), F.sqrt(F.col("xx") * F.col("yy"))).alias("cosine"))


def rank_within(df: DataFrame, keys: list[str], order: list[Column], out: str) -> DataFrame:
    return df.withColumn(out, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
