"""Registered queries over the dual spectra of return windows: corrected loadings, least-variance and index-tracking weights, maps of where a correction pays.

SQL has no eigenvectors, so these have no twins; `tests/test_spectrum.py` and `tests/test_residual_factors.py` hold them against numpy.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelweave.operators import covariance as K
from panelweave.operators import expanding_pca as X
from panelweave.operators import residual_factors as R
from panelweave.operators import spectrum as S
from panelweave.operators import universe as U
from panelweave.operators.spectrum import Estimator
from panelweave.plans import books_panel as B
from panelweave.plans.fixtures import Fixtures, cut
from panelweave.plans.registry import add

#: Windows in weeks; a name's cap; rows a year.
LENGTHS, CAP, WEEKS = [13, 26, 52], 0.2, 52
FAMILY = [
    Estimator("pca1", 1), Estimator("pca3", 3), Estimator("pca5", 5), Estimator("jse1", 1, "all"), Estimator("jse3", 3, "all"), Estimator("jse5", 5, "all"),
    Estimator("gated5", 5, "gated", 0.5, 0.05), Estimator("pca3_idio50", 3, idio=0.5), Estimator("jse3_idio50", 3, "all", idio=0.5), Estimator("trust5", 5, trust=1.0),
]


class Spectra:
    """The spectra, loadings and parts of one set of windows; what several steps start from is materialised once."""

    def __init__(self, returns: DataFrame, lengths: list[int], estimators: list[Estimator], *keys: str) -> None:
        self.keys, self.k, self.estimators = ["n", "month", *keys], max(e.k for e in estimators), estimators
        self.rows = S.windows(returns, lengths, *keys)
        self.x = cut(S.vectors(self.rows, self.keys, "n"))
        self.spec = cut(S.spectrum(self.x, self.keys, self.k))

    def loadings(self) -> DataFrame:
        return S.loadings(self.x, self.spec, self.keys, self.k)

    def states_and_parts(self) -> tuple[DataFrame, DataFrame]:
        load = cut(self.loadings())
        states = cut(S.state(load, self.keys, self.estimators))
        return states, cut(S.parts(load, states, self.keys))


def _universes(x: Fixtures) -> DataFrame:
    """Returns with the half of the names, by volume, that a name belongs to."""
    size = x.bars.groupBy("ticker").agg(F.sum("volume").alias("_v"))
    half = F.when(F.ntile(2).over(Window.orderBy(F.desc("_v"), "ticker")) == 1, "large").otherwise("small")  # one row per name
    return x.returns.select("date", "ticker", "ret").join(size.select("ticker", half.alias("universe")), "ticker")


def _weights(x: Fixtures) -> tuple[Spectra, DataFrame]:
    s = Spectra(x.returns.select("date", "ticker", "ret"), [26], FAMILY)
    return s, S.minimum_variance(s.states_and_parts()[1], s.keys, s.k, CAP)


def _tracking(x: Fixtures) -> DataFrame:
    """The index is the equal-weight universe, the basket its names at odd places of the alphabet."""
    s = Spectra(x.returns.select("date", "ticker", "ret"), [26], FAMILY)
    part = s.states_and_parts()[1]
    names = s.x.select(*s.keys, "ticker")
    group = Window.partitionBy(*s.keys)
    index = names.withColumn("wb", 1 / F.count("*").over(group)).withColumn("basket", F.row_number().over(group.orderBy("ticker")) % 2 == 1)
    return S.tracking(part, index, s.keys, s.k, CAP)


def _crossover(x: Fixtures) -> tuple[DataFrame, list[str]]:
    pair = ("pca3", "jse3")
    s = Spectra(x.returns.select("date", "ticker", "ret"), LENGTHS, [e for e in FAMILY if e.name in pair])
    states, part = s.states_and_parts()
    done = S.outcomes(S.minimum_variance(part, s.keys, s.k, CAP), x.returns, s.keys, WEEKS)
    return S.crossover_rows(done, states, s.spec, s.keys, pair), s.keys


def _crossover_map(x: Fixtures) -> DataFrame:
    rows, keys = _crossover(x)
    return S.crossover_map(rows, keys)


def _regime(x: Fixtures) -> DataFrame:
    pair = ("pca1", "jse1")
    s = Spectra(_universes(x), [13, 52], [e for e in FAMILY if e.name in pair], "universe")
    states, part = s.states_and_parts()
    done = cut(S.outcomes(S.minimum_variance(part, s.keys, s.k, CAP), x.returns, s.keys, WEEKS))
    return S.regime_map(done, states, s.keys, pair)


def _compared(x: Fixtures) -> DataFrame:
    s, weights = _weights(x)
    return S.compared(cut(S.outcomes(weights, x.returns, s.keys, WEEKS)), s.keys, "pca3")


def _book(x: Fixtures, rotate: str) -> DataFrame:
    s = Spectra(x.returns.select("date", "ticker", "ret"), [26], [Estimator("book", 1, rotate, flat=True)])
    w = S.minimum_variance(s.states_and_parts()[1], s.keys, s.k, CAP).where("book = 'long_only'").select("month", "ticker", (2 * F.col("w")).alias("w"))
    return B.monthly_min_variance(w, x.calendar)


def _scores(x: Fixtures) -> DataFrame:
    s = Spectra(x.returns.select("date", "ticker", "ret"), [26], [Estimator("pca3", 3)])
    return S.scores(s.spec, s.rows.select(*s.keys, "date").distinct(), s.keys).select("month", "date", "factor", F.abs("score").alias("size"))


def _noise(x: Fixtures) -> DataFrame:
    s = Spectra(x.returns.select("date", "ticker", "ret"), LENGTHS, [Estimator("pca3", 3)])
    return S.noise(s.spec, s.keys, s.k)


add("minvar_family", lambda x: _weights(x)[1].drop("n"))
add("minvar_tracking", lambda x: _tracking(x).drop("n"))
add("minvar_compared", _compared)
add("crossover_rows", lambda x: _crossover(x)[0])
add("crossover_map", _crossover_map)
add("regime_map", _regime)
add("window_noise", _noise)
add("window_scores", _scores)
for _name, _rotate in (("jse", "all"), ("raw", "none")):
    add(f"book_minvar_{_name}", lambda x, how=_rotate: _book(x, how))

# factors in what known factors leave; components of signals on an expanding history
KNOWN, N_BETA, N_AN = ["mkt_ret", "r0_ret"], 52, 26
_SECTORS = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]


def _analysed(x: Fixtures) -> tuple[DataFrame, DataFrame]:
    rows = cut(R.analysis_windows(x.returns.select("date", "ticker", "ret"), x.macro, KNOWN, N_BETA, N_AN))
    return rows, cut(R.betas(rows, KNOWN))


def _residual(x: Fixtures, with_sectors: bool) -> DataFrame:
    rows, beta = _analysed(x)
    return R.residuals(rows, beta, len(KNOWN), *((x.sectors, _SECTORS) if with_sectors else ()))[0]


def _vetted(x: Fixtures) -> tuple[DataFrame, DataFrame]:
    return R.residual_factors(cut(_residual(x, False)), x.macro.select("date", *KNOWN), KNOWN, k=3, least=5)


def _components(x: Fixtures) -> tuple[DataFrame, DataFrame]:
    scores, load = X.component_returns(U.long_short(x.signals, "1900-01-01"), 5, 24, 12)
    return cut(scores), cut(load)


def _timing(x: Fixtures, timed: bool) -> DataFrame:
    """Signal weights by the components' predicted returns, and by all components alike."""
    scores, load = _components(x)
    dates = U.long_short(x.signals, "1900-01-01").select("date").distinct().withColumn("pos", F.row_number().over(Window.orderBy("date")))
    if not timed:
        return X.signal_weights(load, dates)
    panel = scores.select(F.col("factor").cast("string").alias("signalname"), "date", "ret")
    predicted = K.expanding_ols(K.signal_features(panel, 6), 12, 6)
    return X.signal_weights(load, dates, predicted.select("date", F.col("signalname").cast("int").alias("factor"), F.col("prediction").alias("tilt")))


add("window_residuals", lambda x: _residual(x, False))
add("window_residuals_sectors", lambda x: _residual(x, True))
add("window_angles", lambda x: R.angles(_analysed(x)[1], len(KNOWN)))
add("residual_factor_table", lambda x: _vetted(x)[0])
add("residual_factor_series", lambda x: _vetted(x)[1])
add("expanding_pca", lambda x: _components(x)[0])
add("expanding_pca_timed", lambda x: _timing(x, True))
add("expanding_pca_equal", lambda x: _timing(x, False))
