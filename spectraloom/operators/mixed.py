"""Random-intercept models per key, by restricted maximum likelihood.

``y = X beta + b_subject + e``. With the ratio r of the two variances given, a
subject of n rows has the covariance ``I + r 11'``, whose inverse is
``I - r / (1 + r n) 11'``. So all that a fit needs of a key are, per subject,
sums over its design cells; rows are reduced to those cells in Spark before a
key reaches a task, and what a task holds is bounded by the design. The profiled
criterion is a function of r alone and is searched in one dimension.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from spectraloom.functions import distributions as dist
from spectraloom.functions.session import spread
from spectraloom.operators.models import MODEL_SCHEMA, _term_matrix, design_cells


class RandomIntercept:
    """REML fit of one key from cells with count ``_n``, sum ``_s`` and sum of squares ``_q``."""

    def __init__(self, cells: pd.DataFrame, terms: list[str], subject: str):
        names, blocks = ["(Intercept)"], [np.ones((len(cells), 1))]
        for t in terms:
            labels, block = _term_matrix(cells, t)
            names += labels
            blocks.append(block)
        x, n, s = np.hstack(blocks), cells["_n"].to_numpy(float), cells["_s"].to_numpy(float)
        keep = _independent(x * np.sqrt(n)[:, None])
        self.names, self.x = [names[j] for j in keep], x[:, keep]
        code, subjects = pd.factorize(cells[subject])
        member = np.zeros((len(subjects), len(cells)))
        member[code, np.arange(len(cells))] = 1.0
        self.size = member @ n
        self.xx, self.xy, self.yy = (self.x * n[:, None]).T @ self.x, self.x.T @ s, float(cells["_q"].sum())
        # sums over the rows of a subject
        self.sx, self.sy = member @ (self.x * n[:, None]), member @ s
        self.df = float(n.sum()) - len(keep)
        if self.df <= 0:
            raise ValueError("no residual degrees of freedom")
        if len(subjects) < 2 or self.size.max() < 2:
            raise ValueError("a random intercept needs two subjects and a subject with two rows")
        self.ratio = self._search()
        self.beta, self.inverse, rss, _ = self._solve(self.ratio)
        self.residual = rss / self.df
        self.subject = self.ratio * self.residual

    def _solve(self, ratio: float) -> tuple[np.ndarray, np.ndarray, float, float]:
        shrink = ratio / (1 + ratio * self.size)
        a = self.xx - (self.sx * shrink[:, None]).T @ self.sx
        b = self.xy - self.sx.T @ (shrink * self.sy)
        inverse = np.linalg.inv(a)
        beta = inverse @ b
        rss = self.yy - float(shrink @ self.sy**2) - float(beta @ b)
        return beta, inverse, max(rss, 1e-300), float(np.linalg.slogdet(a)[1])

    def _profiled(self, ratio: float) -> float:
        _, _, rss, logdet = self._solve(ratio)
        return self.df * np.log(rss) + float(np.log1p(ratio * self.size).sum()) + logdet

    def deviance(self, subject: float, residual: float) -> float:
        """Minus twice the restricted log likelihood, up to a constant."""
        ratio = subject / residual
        _, _, rss, logdet = self._solve(ratio)
        return self.df * np.log(residual) + rss / residual + float(np.log1p(ratio * self.size).sum()) + logdet

    def _search(self) -> float:
        """Best ratio: a grid over magnitudes, then golden sections around its best; zero if that is better."""
        grid = np.linspace(np.log(1e-8), np.log(1e8), 81)
        at = int(np.argmin([self._profiled(np.exp(g)) for g in grid]))
        low, high = grid[max(0, at - 1)], grid[min(80, at + 1)]
        golden = (np.sqrt(5) - 1) / 2
        c, d = high - golden * (high - low), low + golden * (high - low)
        fc, fd = self._profiled(np.exp(c)), self._profiled(np.exp(d))
        while high - low > 1e-10:
            if fc < fd:
                high, d, fd = d, c, fc
                c = high - golden * (high - low)
                fc = self._profiled(np.exp(c))
            else:
                low, c, fc = c, d, fd
                d = low + golden * (high - low)
                fd = self._profiled(np.exp(d))
        best = float(np.exp((low + high) / 2))
        return 0.0 if self._profiled(0.0) <= self._profiled(best) else best

    def degrees(self, a: np.ndarray) -> float:
        """Satterthwaite degrees of freedom of ``a beta``; residual ones if the subjects' variance is zero."""
        if self.subject <= 0:
            return self.df
        at = np.array([self.subject, self.residual])
        step = 1e-4 * at

        def variance(v: np.ndarray) -> float:
            return float(a @ self._solve(v[0] / v[1])[1] @ a) * v[1]

        move = np.diag(step)
        gradient = np.array([(variance(at + move[i]) - variance(at - move[i])) / (2 * step[i]) for i in range(2)])
        hessian = np.empty((2, 2))
        for i in range(2):
            for j in range(2):
                up, down = self.deviance(*(at + move[i] + move[j])), self.deviance(*(at - move[i] - move[j]))
                hessian[i, j] = (up - self.deviance(*(at + move[i] - move[j])) - self.deviance(*(at - move[i] + move[j])) + down) / (4 * step[i] * step[j])
        spread_of = float(gradient @ np.linalg.pinv(hessian / 2) @ gradient)
        return 2 * variance(at) ** 2 / spread_of if spread_of > 0 else self.df

    def line(self, label: str, a: np.ndarray) -> tuple:
        estimate, se = float(a @ self.beta), float(np.sqrt(max(a @ self.inverse @ a * self.residual, 0)))
        df, t = self.degrees(a), estimate / se if se > 0 else np.nan
        return label, estimate, se, df, t, float(2 * dist.t_upper(np.array([abs(t)]), np.array([df]))[0])

    def tables(self, cells: pd.DataFrame, terms: list[str], means_of: str | None) -> dict[str, pd.DataFrame]:
        columns = ["term", "estimate", "SE", "df", "stat", "p"]
        out = {"coef": pd.DataFrame([self.line(name, row) for name, row in zip(self.names, np.eye(len(self.names)), strict=True)], columns=columns)}
        out["variance"] = pd.DataFrame({"term": ["subject", "residual"], "estimate": [self.subject, self.residual]})
        if means_of is not None:
            levels, rows = self._level_rows(cells, terms, means_of)
            out["mean"] = pd.DataFrame([self.line(str(lv), rows[lv]) for lv in levels], columns=columns)
            out["contrast"] = pd.DataFrame([self.line(f"{a}-{b}", rows[a] - rows[b]) for i, a in enumerate(levels) for b in levels[i + 1 :]], columns=columns)
        return out

    def _level_rows(self, cells: pd.DataFrame, terms: list[str], factor: str) -> tuple[list, dict]:
        """For each level of the factor the mean design row over the other factors' levels."""
        others = [c for c in dict.fromkeys(c for t in terms for c in t.split(":")) if c != factor]
        choices = [[cells[c].mean()] if pd.api.types.is_numeric_dtype(cells[c]) else sorted(cells[c].dropna().unique()) for c in others]
        levels = sorted(cells[factor].dropna().unique())
        grid = pd.MultiIndex.from_product([levels, *choices], names=[factor, *others]).to_frame(index=False)
        both = pd.concat([cells[[factor, *others]], grid], ignore_index=True)
        names, blocks = ["(Intercept)"], [np.ones((len(both), 1))]
        for t in terms:
            labels, block = _term_matrix(both, t)
            names += labels
            blocks.append(block)
        x = np.hstack(blocks)[len(cells) :][:, [names.index(n) for n in self.names]]
        return levels, {lv: x[(grid[factor] == lv).to_numpy()].mean(axis=0) for lv in levels}


def _independent(x: np.ndarray) -> list[int]:
    """Columns that earlier ones do not explain."""
    keep, basis = [], np.zeros((len(x), 0))
    for j in range(x.shape[1]):
        rest = x[:, j] - basis @ (basis.T @ x[:, j])
        rest = rest - basis @ (basis.T @ rest)
        if np.linalg.norm(rest) > 1e-7 * max(np.linalg.norm(x[:, j]), 1e-300):
            keep.append(j)
            basis = np.hstack([basis, (rest / np.linalg.norm(rest))[:, None]])
    return keep


def mixed_models(df: DataFrame, key: str, y: str, terms: list[str], subject: str, means_of: str | None = None) -> DataFrame:
    """Per key a random intercept of ``subject``: kinds coef, variance, and with ``means_of`` mean and contrast.

    Degrees of freedom are Satterthwaite's. Rows without a value or a subject
    are left out; a key that cannot be fitted gives one row of kind ``error``.
    """
    columns = [c for c in dict.fromkeys([subject, *(c for t in terms for c in t.split(":"))])]
    cells = design_cells(df.where(f"`{subject}` is not null"), [key], columns, y)
    kind = df.schema[key].dataType.simpleString()

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        try:
            tables = RandomIntercept(pdf, terms, subject).tables(pdf, terms, means_of)
            out = pd.concat([t.assign(kind=k, error=None) for k, t in tables.items()], ignore_index=True)
        except Exception as e:  # noqa: BLE001
            out = pd.DataFrame([{"kind": "error", "error": str(e)}])
        out = out.assign(model="mixed").reindex(columns=["model", "kind", "term", "estimate", "SE", "df", "stat", "p", "warning", "error"])
        for c in ("model", "kind", "term", "warning", "error"):
            out[c] = [v if isinstance(v, str) else None for v in out[c]]
            out[c] = out[c].astype(object)
        out.insert(0, key, pdf[key].iloc[0])
        return out

    return spread(cells, key).groupBy(key).applyInPandas(fit, f"`{key}` {kind}, {MODEL_SCHEMA}")
