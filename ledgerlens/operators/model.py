"""Multi-target linear models trained from distributed sufficient statistics
(M1-M9, A13, A14) and their tidy coefficient table (S21).

Training never gathers rows: the driver only sees d x d matrices
(d = intercept + features + targets), which are accumulated per task by
``mapInPandas`` over Arrow batches and summed by a Spark aggregate.

* split (M6): deterministic hash split of the rows with sklearn's sizes at
  every grain (``operators.split``); without ``exact_split`` a fraction of the
  hashes, whose sizes are approximate;
* imputation (M1, M2): exact training medians (skew-safe) and modes;
* scaling (M3): training mean and *population* std, zero std -> 1;
* one-hot (M4): training levels, unseen / NULL-after-impute -> all zeros; the
  categorical with the most levels, if it has more than ``WIDE_LEVELS``, stays
  a table and is eliminated from the normal equations (``operators.wide``);
* OLS (M7): minimum-norm solution ``pinv(Xc'Xc) Xc'yc``, intercept
  unpenalised; ridge (M8): ``(Xc'Xc + aI)^-1 Xc'yc`` with the alpha of
  least exact leave-one-out error per target (first alpha on ties);
* metrics (A13) and choice (A14) on the held-out rows, one aggregate.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.operators import wide
from ledgerlens.operators.medians import exact_medians
from ledgerlens.operators.rollup import modes
from ledgerlens.operators.split import exact_split as _exact_split
from ledgerlens.schema import COSTS, DATE_FEATURES, DIMS, FACTORS, RIDGE_ALPHAS, TARGETS
from ledgerlens.shared import materialise

#: More levels than this make the largest categorical a table.
WIDE_LEVELS = 256
#: Levels of each other categorical, whose one-hot columns are in the driver's matrices: more is an error, never a cap.
MAX_LEVELS = 4_096


@dataclass
class LinearModel:
    name: str
    targets: list[str]
    numeric: list[str]
    categorical: list[str]
    medians: dict[str, float] = field(default_factory=dict)
    modes: dict[str, str | None] = field(default_factory=dict)
    means: dict[str, float] = field(default_factory=dict)
    scales: dict[str, float] = field(default_factory=dict)
    levels: dict[str, list[str]] = field(default_factory=dict)
    # (algo, target) -> (intercept, coefficient vector in design order)
    coefs: dict[tuple[str, str], tuple[float, list[float]]] = field(default_factory=dict)
    alphas: dict[str, float] = field(default_factory=dict)
    best: dict[str, str] = field(default_factory=dict)
    n_train: int = 0
    n_test: int = 0
    # the categorical kept as a table, and that table: category, then one column <algo>__<target> each
    wide: str | None = None
    wide_table: DataFrame | None = None

    @property
    def dense(self) -> list[str]:
        return [c for c in self.categorical if c != self.wide]

    @property
    def features(self) -> list[str]:
        return self.categorical + self.numeric

    def design_names(self) -> list[tuple[str, str | None]]:
        return ([(f, None) for f in self.numeric]
                + [(c, lv) for c in self.dense for lv in self.levels[c]])

    # -- design expressions (Catalyst, no Python) --------------------------
    def numeric_expr(self, df_cols: list[str], f: str) -> Column:
        x = F.col(f).cast("double") if f in df_cols else F.lit(None).cast("double")
        x = F.when(F.isnan(x), None).otherwise(x)
        return (F.coalesce(x, F.lit(self.medians[f])) - F.lit(self.means[f])) / F.lit(self.scales[f])

    def category_expr(self, df_cols: list[str], c: str) -> Column:
        x = F.col(c).cast("string") if c in df_cols else F.lit(None).cast("string")
        mode = self.modes.get(c)
        return F.coalesce(x, F.lit(mode).cast("string")) if mode is not None else x

    def design(self, df_cols: list[str]) -> list[Column]:
        out = [self.numeric_expr(df_cols, f) for f in self.numeric]
        for c in self.dense:
            key = self.category_expr(df_cols, c)
            out += [F.when(key == F.lit(lv), 1.0).otherwise(0.0) for lv in self.levels[c]]
        return out

    def prepare(self, df: DataFrame) -> DataFrame:
        """Imputed numerics (``_x_*``) and imputed category keys (``_k_*``)
        as columns computed once, shared by every target's prediction (keeps
        the generated code per stage small and the work per row minimal)."""
        cols = df.columns
        new = {}
        for f in self.numeric:
            x = F.col(f).cast("double") if f in cols else F.lit(None).cast("double")
            new[f"_x_{f}"] = F.coalesce(F.when(F.isnan(x), None).otherwise(x), F.lit(self.medians[f]))
        for c in self.categorical:
            new[f"_k_{c}"] = self.category_expr(cols, c)
        df = df.withColumns(new) if new else df
        if self.wide:
            # levels' coefficients come by a join: broadcast below Spark's threshold, else shuffled, hot levels split (AQE)
            table = self.wide_table.select(F.col("category").alias("_wide"), *[F.col(c).alias(f"_w_{c}") for c in self._wide_columns()])
            df = df.join(table, F.col(f"_k_{self.wide}") == F.col("_wide"), "left")
        return df

    def _wide_columns(self) -> list[str]:
        return [f"{algo}__{y}" for y in self.targets for algo in ("baseline", "ridge")]

    def helper_columns(self) -> list[str]:
        wide = ["_wide", *[f"_w_{c}" for c in self._wide_columns()]] if self.wide else []
        return [f"_x_{f}" for f in self.numeric] + [f"_k_{c}" for c in self.categorical] + wide

    def prepared_prediction(self, algo: str, target: str) -> Column:
        """Prediction over a ``prepare``-d frame: constant + sum of weight x
        imputed numeric + one literal-map lookup per dense categorical + the
        joined coefficient of the wide one."""
        b0, w = self.coefs[(algo, target)]
        k = 0
        const = b0
        terms = []
        for f in self.numeric:
            c = w[k] / self.scales[f]
            const -= c * self.means[f]
            terms.append(F.col(f"_x_{f}") * F.lit(c))
            k += 1
        if self.wide:
            terms.append(F.coalesce(F.col(f"_w_{algo}__{target}"), F.lit(0.0)))
        for cat in self.dense:
            lv = self.levels[cat]
            m = F.create_map(*[v for i, l in enumerate(lv) for v in (F.lit(l), F.lit(w[k + i]))])
            terms.append(F.coalesce(F.try_element_at(m, F.col(f"_k_{cat}")), F.lit(0.0)))
            k += len(lv)
        expr = F.lit(const)
        for term in terms:
            expr = expr + term
        return expr

    def prediction(self, df_cols: list[str], algo: str, target: str) -> Column:
        """Self-contained prediction expression (no ``prepare`` needed); not
        for a model with a wide categorical."""
        if self.wide:
            raise ValueError(f"the levels of {self.wide} are a table: score with prepare and prepared_prediction")
        b0, w = self.coefs[(algo, target)]
        k = 0
        const = b0
        expr = None
        for f in self.numeric:
            c = w[k] / self.scales[f]
            const -= c * self.means[f]
            x = F.col(f).cast("double") if f in df_cols else F.lit(None).cast("double")
            x = F.coalesce(F.when(F.isnan(x), None).otherwise(x), F.lit(self.medians[f]))
            term = x * F.lit(c)
            expr = term if expr is None else expr + term
            k += 1
        for cat in self.categorical:
            lv = self.levels[cat]
            m = F.create_map(*[v for i, l in enumerate(lv) for v in (F.lit(l), F.lit(w[k + i]))])
            term = F.coalesce(F.try_element_at(m, self.category_expr(df_cols, cat)), F.lit(0.0))
            expr = term if expr is None else expr + term
            k += len(lv)
        return F.lit(const) if expr is None else F.lit(const) + expr

    # -- tidy table (S21) --------------------------------------------------
    def to_table(self, spark: SparkSession) -> DataFrame:
        rows = []
        add = lambda kind, target=None, algo=None, feature=None, category=None, value=None, text=None: \
            rows.append((self.name, kind, target, algo, feature, category,
                         None if value is None else float(value), text))
        for t in self.targets:
            add("target", target=t, text=self.best.get(t))
            if t in self.alphas:
                add("alpha", target=t, value=self.alphas[t])
        for f in self.numeric:
            add("numeric", feature=f, value=self.medians[f], text="median")
            add("mean", feature=f, value=self.means[f])
            add("scale", feature=f, value=self.scales[f])
        for c in self.categorical:
            add("wide" if c == self.wide else "categorical", feature=c, text=self.modes.get(c))
            for lv in self.levels.get(c, []):
                add("level", feature=c, category=lv)
        names = self.design_names()
        for (algo, t), (b0, w) in self.coefs.items():
            add("intercept", target=t, algo=algo, value=b0)
            for (f, lv), v in zip(names, w):
                add("coef", target=t, algo=algo, feature=f, category=lv, value=v)
        add("size", feature="n_train", value=self.n_train)
        add("size", feature="n_test", value=self.n_test)
        schema = ("model_name string, kind string, target string, algo string, feature string, "
                  "category string, value double, text string")
        out = spark.createDataFrame(rows, schema)
        if self.wide:
            entries = F.explode(F.array(*[F.struct(F.lit(y).alias("target"), F.lit(a).alias("algo"), F.col(f"{a}__{y}").alias("value"))
                                          for y in self.targets for a in ("baseline", "ridge")])).alias("e")
            out = out.unionByName(self.wide_table.select("category", entries).select(
                F.lit(self.name).alias("model_name"), F.lit("level_coef").alias("kind"), "e.target", "e.algo", F.lit(self.wide).alias("feature"),
                "category", "e.value", F.lit(None).cast("string").alias("text")))
        return out

    @staticmethod
    def from_table(table: DataFrame, name: str) -> "LinearModel":
        """Rebuild a model from the coefficient table; levels of a wide
        categorical stay a table."""
        one = table.where(F.col("model_name") == name)
        rows = one.where("kind <> 'level_coef'").collect()
        if not rows:
            raise FileNotFoundError(f"model {name!r} not found")
        m = LinearModel.from_rows(rows)
        if m.wide:
            m.wide_table = one.where("kind = 'level_coef'").groupBy("category").agg(*[
                F.max(F.when((F.col("algo") == a) & (F.col("target") == y), F.col("value"))).alias(f"{a}__{y}")
                for y in m.targets for a in ("baseline", "ridge")])
        return m

    @staticmethod
    def from_rows(rows) -> "LinearModel":
        """Rebuild from the collected coefficient table of one model (one row
        per design column per target; no level of a wide categorical)."""
        rows = list(rows)
        name = rows[0]["model_name"]
        m = LinearModel(name, [], [], [])
        levels: dict[str, list[str]] = {}
        coef_rows: dict[tuple[str, str], dict] = {}
        for r in rows:
            k = r["kind"]
            if k == "target":
                m.targets.append(r["target"])
                if r["text"]:
                    m.best[r["target"]] = r["text"]
            elif k == "alpha":
                m.alphas[r["target"]] = r["value"]
            elif k == "numeric":
                m.numeric.append(r["feature"]); m.medians[r["feature"]] = r["value"]
            elif k == "mean":
                m.means[r["feature"]] = r["value"]
            elif k == "scale":
                m.scales[r["feature"]] = r["value"]
            elif k in ("categorical", "wide"):
                m.categorical.append(r["feature"]); m.modes[r["feature"]] = r["text"]
                m.wide = r["feature"] if k == "wide" else m.wide
            elif k == "level":
                levels.setdefault(r["feature"], []).append(r["category"])
            elif k == "intercept":
                coef_rows.setdefault((r["algo"], r["target"]), {})["_b0"] = r["value"]
            elif k == "coef":
                coef_rows.setdefault((r["algo"], r["target"]), {})[(r["feature"], r["category"])] = r["value"]
            elif k == "size":
                setattr(m, r["feature"], int(r["value"]))
        m.levels = {c: sorted(levels.get(c, [])) for c in m.dense}
        names = m.design_names()
        for key, d in coef_rows.items():
            m.coefs[key] = (d["_b0"], [d.get(n, 0.0) for n in names])
        return m


# ---------------------------------------------------------------------------
# distributed passes
# ---------------------------------------------------------------------------
def _gram_fn(width: int):
    def run(batches):
        g = np.zeros((width, width))
        seen = False
        for pdf in batches:
            if len(pdf) == 0:
                continue
            seen = True
            a = np.empty((len(pdf), width))
            a[:, 0] = 1.0
            a[:, 1:] = pdf.to_numpy(dtype=np.float64, na_value=np.nan)
            g += a.T @ a
        if seen:
            i, j = np.triu_indices(width)
            yield pd.DataFrame({"i": i.astype(np.int32), "j": j.astype(np.int32), "v": g[i, j]})
    return run


def gram_matrix(rows: DataFrame, cols: list[Column]) -> np.ndarray:
    """Augmented Gram matrix of ``[1, cols...]`` summed over all rows: one
    pass, ``width^2 / 2`` rows shuffled per task."""
    width = len(cols) + 1
    x = rows.select(*[c.alias(f"c{k}") for k, c in enumerate(cols)])
    parts = x.mapInPandas(_gram_fn(width), "i int, j int, v double")
    got = parts.groupBy("i", "j").agg(F.sum("v").alias("v")).collect()
    g = np.zeros((width, width))
    for r in got:
        g[r["i"], r["j"]] = r["v"]
        g[r["j"], r["i"]] = r["v"]
    return g


def _loo_fn(p: int, t: int, xm, invs, coefs, n):
    def run(batches):
        sse = np.zeros((len(invs), t))
        seen = False
        for pdf in batches:
            if len(pdf) == 0:
                continue
            seen = True
            a = pdf.to_numpy(dtype=np.float64, na_value=np.nan)
            x, y = a[:, :p], a[:, p:]
            xc = x - xm
            for k, (inv, (b0, b)) in enumerate(zip(invs, coefs)):
                h = 1.0 / n + np.einsum("ij,jk,ik->i", xc, inv, xc)
                r = (y - (b0 + x @ b)) / (1.0 - h)[:, None]
                sse[k] += (r * r).sum(axis=0)
        if seen:
            a_idx, t_idx = np.meshgrid(np.arange(len(invs)), np.arange(t), indexing="ij")
            yield pd.DataFrame({"a": a_idx.ravel().astype(np.int32), "t": t_idx.ravel().astype(np.int32),
                                "sse": sse.ravel()})
    return run


def _split(df: DataFrame, key_cols: list[str], test_size: float, seed: int, exact: bool, written: bool = False):
    h = F.xxhash64(*[F.col(c) for c in key_cols], F.lit(seed))
    if test_size <= 0:
        return df.withColumn("_test", F.lit(False))
    if exact:
        return _exact_split(df, key_cols, test_size, seed, written)
    u = F.pmod(h, F.lit(1_000_000)) / 1_000_000.0
    return df.withColumn("_test", u < F.lit(test_size))


def train_model(data: DataFrame, name: str = "model", targets: list[str] | None = None,
                features: list[str] | None = None, test_size: float = 0.25, seed: int = 42,
                split_keys: list[str] | None = None, exact_split: bool = True,
                alphas: list[float] | None = None, wide_levels: int = WIDE_LEVELS) -> tuple[LinearModel, DataFrame | None]:
    """Fit the baseline (OLS) and ridge models for every target present.

    ``data`` is the model matrix (daily roll-up by default).  Returns the
    fitted model and its metrics frame (None without a test split).  The
    largest categorical may have any number of levels."""
    spark = data.sparkSession
    alphas = alphas or RIDGE_ALPHAS
    cols = set(data.columns)
    targets = [t for t in (targets or TARGETS) if t in cols]
    if not targets:
        raise ValueError(f"none of the targets {TARGETS} is in the data")
    if features is None:
        features = [c for c in DIMS + COSTS + DATE_FEATURES + FACTORS if c in cols]
    categorical = [c for c in features if c in DIMS]
    numeric = [c for c in features if c not in categorical]
    split_keys = split_keys or (["order_date"] if "order_date" in cols else list(data.columns))

    base = data.select(*features, *targets, *[c for c in split_keys if c not in features + targets])
    base = materialise(base, "training-rows")
    return _train(_split(base, split_keys, test_size, seed, exact_split, True), LinearModel(name, targets, numeric, categorical),
                  test_size, alphas, wide_levels)


def _train(base: DataFrame, m: LinearModel, test_size: float, alphas: list[float], wide_levels: int) -> tuple[LinearModel, DataFrame | None]:
    spark, targets, numeric, categorical = base.sparkSession, m.targets, m.numeric, m.categorical
    train = base.where(~F.col("_test"))

    # M1 / M2: medians (exact, skew-safe) and modes fitted on the train rows
    if numeric:
        med = exact_medians(train, [], numeric, written=True).first()
        m.medians = {f: (0.0 if med[f] is None else float(med[f])) for f in numeric}
    if categorical:
        commonest = modes(train.withColumn("_all", F.lit(1)), ["_all"], categorical).first()
        m.modes = {c: commonest[c] if commonest else None for c in categorical}
    # M3: mean / population std of the imputed numerics
    if numeric:
        imp = {f: F.coalesce(F.when(F.isnan(F.col(f).cast("double")), None)
                             .otherwise(F.col(f).cast("double")), F.lit(m.medians[f])) for f in numeric}
        st = train.agg(*[F.avg(e).alias(f"m_{f}") for f, e in imp.items()],
                       *[F.stddev_pop(e).alias(f"s_{f}") for f, e in imp.items()]).first()
        for f in numeric:
            m.means[f] = float(st[f"m_{f}"] or 0.0)
            s = float(st[f"s_{f}"] or 0.0)
            m.scales[f] = s if s > 1e-12 * max(1.0, abs(m.means[f])) else 1.0
    # M4: training levels; the most numerous stay a table where there are many
    keys = {c: m.category_expr(train.columns, c) for c in categorical}
    counts = train.agg(*[F.count_distinct(k).alias(c) for c, k in keys.items()]).first() if categorical else {}
    largest = max(categorical, key=lambda c: counts[c], default=None)
    if largest and counts[largest] > wide_levels:
        m.wide = largest
    for c in m.dense:
        if counts[c] > MAX_LEVELS:
            raise ValueError(f"{c}, beside the larger {m.wide}, has more than {MAX_LEVELS} levels")
        m.levels[c] = sorted(r[0] for r in train.select(keys[c].alias("v")).where(F.col("v").isNotNull()).distinct().collect())
    if m.wide:
        wide.fit(train.dropna(subset=targets), m, alphas)
    else:
        _fit_dense(train, m, alphas)
    return _evaluated(base, m, test_size)


def _fit_dense(train: DataFrame, m: LinearModel, alphas: list[float]) -> None:
    targets = m.targets
    design = m.design(train.columns)
    p, t = len(design), len(targets)
    g = gram_matrix(train.dropna(subset=targets), design + [F.col(y).cast("double") for y in targets])
    n = g[0, 0]
    if n < 1:
        raise ValueError("no training rows")
    m.n_train = int(n)
    sx, sy = g[0, 1:1 + p], g[0, 1 + p:]
    xm, ym = sx / n, sy / n
    cxx = g[1:1 + p, 1:1 + p] - n * np.outer(xm, xm)
    cxy = g[1:1 + p, 1 + p:] - n * np.outer(xm, ym)
    # M7: minimum-norm least squares (rank-deficient with full one-hot)
    b = np.linalg.pinv(cxx, rcond=1e-10, hermitian=True) @ cxy
    for k, y in enumerate(targets):
        m.coefs[("baseline", y)] = (float(ym[k] - xm @ b[:, k]), [float(v) for v in b[:, k]])
    # M8: ridge for every alpha, exact leave-one-out error in a second pass
    invs, fits = [], []
    for a in alphas:
        inv = np.linalg.inv(cxx + a * np.eye(p))
        ba = inv @ cxy
        invs.append(inv)
        fits.append((ym - xm @ ba, ba))
    loo = (train.dropna(subset=targets)
           .select(*[c.alias(f"c{k}") for k, c in enumerate(design)],
                   *[F.col(y).cast("double").alias(f"y{k}") for k, y in enumerate(targets)])
           .mapInPandas(_loo_fn(p, t, xm, invs, fits, n), "a int, t int, sse double")
           .groupBy("a", "t").agg(F.sum("sse").alias("sse")).collect())
    sse = np.full((len(alphas), t), np.inf)
    for r in loo:
        sse[r["a"], r["t"]] = r["sse"]
    for k, y in enumerate(targets):
        ai = int(np.argmin(sse[:, k]))          # first alpha on ties
        b0, ba = fits[ai]
        m.alphas[y] = float(alphas[ai])
        m.coefs[("ridge", y)] = (float(b0[k]), [float(v) for v in ba[:, k]])


def _evaluated(base: DataFrame, m: LinearModel, test_size: float) -> tuple[LinearModel, DataFrame | None]:
    targets, spark = m.targets, base.sparkSession
    # Metrics on the held-out rows
    test = base.where(F.col("_test")).dropna(subset=targets)
    if test_size <= 0:
        m.best = {y: "ridge" for y in targets}
        return m, None
    metrics = evaluate(m, test)
    rows = {(r["target"], r["model"]): r for r in metrics.collect()}
    m.n_test = int(test.count())
    for y in targets:
        rb, rr = rows.get((y, "baseline")), rows.get((y, "ridge"))
        m.best[y] = "ridge" if (rr and rb and rr["R2"] >= rb["R2"]) else "baseline"
    spark_rows = [(y, a, r["MAE"], r["RMSE"], r["R2"], r["MAPE"], m.alphas.get(y) if a == "ridge" else None,
                   m.best[y]) for (y, a), r in sorted(rows.items())]
    out = spark.createDataFrame(spark_rows, "target string, model string, MAE double, RMSE double, "
                                            "R2 double, MAPE double, alpha double, best string")
    return m, out


def evaluate(m: LinearModel, test: DataFrame) -> DataFrame:
    """MAE, RMSE, R2 (6 dp), MAPE (over non-zero actuals, D6) per target
    and model, in one aggregate over the test rows."""
    test = m.prepare(test)
    aggs = []
    keys = []
    for y in m.targets:
        yv = F.col(y).cast("double")
        for algo in ("baseline", "ridge"):
            e = yv - m.prepared_prediction(algo, y)
            k = f"{y}__{algo}"
            keys.append((y, algo, k))
            aggs += [F.avg(F.abs(e)).alias(f"{k}_mae"),
                     F.sqrt(F.avg(e * e)).alias(f"{k}_rmse"),
                     F.sum(e * e).alias(f"{k}_sse"),
                     (F.var_pop(yv) * F.count(yv)).alias(f"{k}_sst"),
                     F.avg(F.when(yv != 0, F.abs(e / yv))).alias(f"{k}_mape")]
    r = test.agg(*aggs).first()
    out = []
    for y, algo, k in keys:
        sse, sst = r[f"{k}_sse"], r[f"{k}_sst"]
        if sst is None or sse is None:
            r2 = float("nan")
        elif sst == 0:
            r2 = 1.0 if sse == 0 else 0.0
        else:
            r2 = 1 - sse / sst
        out.append((y, algo, round(float(r[f"{k}_mae"] or 0.0), 4), round(float(r[f"{k}_rmse"] or 0.0), 4),
                    round(r2, 6), round(float(r[f"{k}_mape"] or 0.0) * 100, 4)))
    return test.sparkSession.createDataFrame(
        out, "target string, model string, MAE double, RMSE double, R2 double, MAPE double")


def save_model(m: LinearModel, path: str, spark: SparkSession) -> None:
    """Coefficient table, one partition per model (dynamic overwrite)."""
    m.to_table(spark).write.option("partitionOverwriteMode", "dynamic").mode("overwrite").partitionBy("model_name").parquet(path)


def load_model(spark: SparkSession, path: str, name: str) -> LinearModel:
    return LinearModel.from_table(spark.read.parquet(path), name)


def drop_model(spark: SparkSession, path: str, name: str) -> None:
    """Remove a model's partition of the coefficient table; the other
    models' partitions aren't touched."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path, f"model_name={name}")
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
