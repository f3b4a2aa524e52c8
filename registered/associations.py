from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from registered import query, rounded
from registered.tables import KEY, LINEITEM_NUMERIC, LINEITEM_ORDER, LINEITEM_TEXT
from seriesloom.operators import associations, rowindex

PAIRS = list(combinations(LINEITEM_NUMERIC, 2))
CORR = "p AS (" + " UNION ALL ".join(f"SELECT '{a}' AS feature1, '{b}' AS feature2, corr({a}, {b}) AS correlation FROM lineitem" for a, b in PAIRS) + ")"
# Columns tied to each other: a price with and without discount, and a quantity in other units.
TIED = """(SELECT l_quantity, l_extendedprice, l_discount, l_tax, l_extendedprice * (1 - l_discount) AS net_price, l_quantity * 12 + l_linenumber AS pieces, l_linenumber FROM lineitem)"""
TIED_COLUMNS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "net_price", "pieces", "l_linenumber"]
TIED_CORR = "p AS (" + " UNION ALL ".join(f"SELECT '{a}' AS feature1, '{b}' AS feature2, corr({a}, {b}) AS correlation FROM {TIED}" for a, b in combinations(TIED_COLUMNS, 2)) + ")"


def tied(t):
    return t("lineitem").select(
        "l_quantity", "l_extendedprice", "l_discount", "l_tax", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("net_price"),
        (F.col("l_quantity") * 12 + F.col("l_linenumber")).alias("pieces"), "l_linenumber")


@query("corr_matrix", f"WITH {CORR} SELECT feature1, feature2, round(correlation, 6) AS correlation FROM p")
def corr_matrix(t):
    return rounded(associations.corr_matrix(t("lineitem"), LINEITEM_NUMERIC), 6, "correlation")


@query("target_corr", " UNION ALL ".join(f"SELECT '{c}' AS feature, round(abs(corr({c}, net_price)), 6) AS correlation FROM {TIED}" for c in TIED_COLUMNS if c != "net_price") + " ORDER BY 2 DESC LIMIT 10")
def target_corr(t):
    return rounded(associations.target_corr(tied(t), "net_price"), 6, "correlation")


@query("strong_pairs", f"WITH {TIED_CORR} SELECT feature1, feature2, round(correlation, 6) AS correlation FROM (SELECT * FROM p ORDER BY abs(correlation) DESC LIMIT 10) WHERE abs(correlation) > 0.85")
def strong_pairs(t):
    return rounded(associations.strong_pairs(associations.corr_matrix(tied(t))), 6, "correlation")


@query("redundant_pairs", f"WITH {TIED_CORR} SELECT feature1, feature2, round(correlation, 6) AS correlation FROM p WHERE abs(correlation) > 0.92 ORDER BY 1, 2 LIMIT 8")
def redundant_pairs(t):
    return rounded(associations.redundant_pairs(associations.corr_matrix(tied(t))), 6, "correlation")


@query("mirror_matrix", f"WITH {CORR}, f AS (SELECT unnest(list_distinct(list_concat(list(feature1), list(feature2)))) AS f FROM p) SELECT a.f AS feature1, b.f AS feature2, round(CASE WHEN a.f = b.f THEN 1 ELSE coalesce(x.correlation, y.correlation, 0) END, 6) AS correlation FROM f a, f b LEFT JOIN p x ON x.feature1 = a.f AND x.feature2 = b.f LEFT JOIN p y ON y.feature1 = b.f AND y.feature2 = a.f")
def mirror_matrix(t):
    return rounded(associations.mirror_matrix(associations.corr_matrix(t("lineitem"), LINEITEM_NUMERIC)), 6, "correlation")


# Seven columns besides the target: the greedy choice spelled out as three recursive picks after the first four.
@query("diverse_features", f"""WITH RECURSIVE {TIED_CORR}, b AS (SELECT feature1 AS a, feature2 AS b, correlation AS r FROM p UNION ALL SELECT feature2, feature1, correlation FROM p),
rk AS (SELECT b AS f, row_number() OVER (ORDER BY abs(r) DESC, b) AS k FROM b WHERE a = 'net_price'),
walk AS (SELECT 4::BIGINT AS k, (SELECT list(f) FROM rk WHERE k <= 4) AS kept, 0 AS extra
 UNION ALL SELECT w.k + 1,
  CASE WHEN w.extra < 3 AND (SELECT max(abs(r)) FROM b WHERE b.a = rk.f AND list_contains(w.kept, b.b)) < 0.85 THEN list_append(w.kept, rk.f) ELSE w.kept END,
  CASE WHEN w.extra < 3 AND (SELECT max(abs(r)) FROM b WHERE b.a = rk.f AND list_contains(w.kept, b.b)) < 0.85 THEN w.extra + 1 ELSE w.extra END
 FROM walk w JOIN rk ON rk.k = w.k + 1),
fin AS (SELECT list_append(kept, 'net_price') AS kept FROM walk ORDER BY k DESC LIMIT 1)
SELECT a AS feature1, b AS feature2, round(r, 6) AS correlation FROM b, fin WHERE list_contains(kept, a) AND list_contains(kept, b)""")
def diverse_features(t):
    return rounded(associations.diverse_features(tied(t), "net_price"), 6, "correlation")


LAG = "x AS (SELECT *, {lags} FROM lineitem)"
ORDER_SQL = ", ".join(LINEITEM_ORDER)
SIGNAL_FEATURES = ["l_linenumber", "l_quantity", "l_discount", "l_tax"]


def _signals() -> str:
    lags = ", ".join(f"lag({c}) OVER w AS p_{c}" for c in SIGNAL_FEATURES)
    parts = " UNION ALL ".join(f"SELECT '{c}' AS feature, abs(corr({c}, l_extendedprice)) AS same_time, abs(corr(p_{c}, l_extendedprice)) AS lag FROM x" for c in SIGNAL_FEATURES)
    return f"x AS (SELECT *, {lags} FROM lineitem WINDOW w AS (ORDER BY {ORDER_SQL})), num AS (SELECT feature, 'pearson' AS method, same_time, lag, CASE WHEN greatest(same_time, lag) > 0.45 THEN 'strong_driver' ELSE 'weak_or_contextual' END AS role FROM ({parts}))"


def _eta(table: str, target: str, columns: list[str]) -> str:
    return " UNION ALL ".join(f"""SELECT '{c}' AS feature, least(1, sum(k * (m - g) * (m - g)) / any_value(ss)) AS e FROM (SELECT count(*) AS k, avg({target}) AS m FROM {table} GROUP BY {c}),
 (SELECT avg({target}) AS g, var_pop({target}) * count({target}) AS ss FROM {table})""" for c in columns)


ETA = "cat AS (SELECT feature, 'eta_squared' AS method, e AS same_time, 0.0 AS lag, CASE WHEN e > 0.06 THEN 'strong_driver' ELSE 'weak_or_contextual' END AS role FROM ({parts}))"


def _numeric_signals(t):
    indexed = rowindex.with_row_index(t("lineitem"), LINEITEM_ORDER)
    return associations.predictive_signals(indexed, "l_extendedprice", SIGNAL_FEATURES)


@query("predictive_signals", f"WITH {_signals()} SELECT feature, method, round(same_time, 6) AS same_time, round(lag, 6) AS lag, role FROM num")
def predictive_signals(t):
    return rounded(_numeric_signals(t), 6, "same_time", "lag")


@query("eta_squared", f"WITH {ETA.format(parts=_eta('lineitem', 'l_extendedprice', LINEITEM_TEXT))} SELECT feature, method, round(same_time, 8) AS same_time, lag, role FROM cat")
def eta_squared(t):
    return rounded(associations.eta_squared(t("lineitem"), "l_extendedprice", LINEITEM_TEXT), 8, "same_time")


@query("rank_signals", f"WITH {_signals()}, {ETA.format(parts=_eta('lineitem', 'l_extendedprice', LINEITEM_TEXT))} SELECT feature, method, round(same_time, 6) AS same_time, round(lag, 6) AS lag, role FROM (SELECT * FROM num UNION ALL SELECT * FROM cat) ORDER BY greatest(same_time, lag) DESC LIMIT 10")
def rank_signals(t):
    both = _numeric_signals(t).unionByName(associations.eta_squared(t("lineitem"), "l_extendedprice", LINEITEM_TEXT))
    return rounded(associations.rank_signals(both), 6, "same_time", "lag")


@query("eta_squared_documents", f"WITH {ETA.format(parts=_eta('documents', 'n_chars', ['lang', 'source']))} SELECT feature, method, round(same_time, 6) AS same_time, lag, role FROM cat")
def eta_squared_documents(t):
    return rounded(associations.eta_squared(t("documents"), "n_chars", ["lang", "source"]), 6, "same_time")
