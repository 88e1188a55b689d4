"""DuckDB twins for folds, Naive Bayes and evaluation.

The SQL states the naive definition: for every fold, training counts are
summed over the documents of the other folds (a per-fold filter), which
the Spark plan replaces by ``total - fold``.
"""

from __future__ import annotations


def folds_sql(docs_sql: str, k=10, seed=1, repeats=1) -> str:
    return (f"SELECT d.doc_id, CAST(r.repeat AS INTEGER) AS repeat, CAST(ntile({k}) OVER (PARTITION BY r.repeat "
            f"ORDER BY md5(concat(CAST(d.doc_id AS VARCHAR), ':', CAST({seed} + r.repeat - 1 AS VARCHAR))), d.doc_id) AS INTEGER) AS fold "
            f"FROM (SELECT DISTINCT doc_id FROM ({docs_sql})) d CROSS JOIN (SELECT unnest(range(1, {repeats + 1})) AS repeat) r")


def _train_selection_sql(top: int) -> str:
    """``sel(repeat, fold, feature)``: per-class top features by the tf-idf of the training documents of each fold."""
    return f"""
trc AS MATERIALIZED (SELECT fl.repeat, fl.fold, c.label, c.feature, c.n
        FROM counts c JOIN dd ON c.doc_id = dd.doc_id JOIN fl ON dd.repeat = fl.repeat AND dd.fold <> fl.fold),
ntr AS (SELECT fl.repeat, fl.fold, count(*) AS nd FROM fl JOIN dd ON dd.repeat = fl.repeat AND dd.fold <> fl.fold GROUP BY ALL),
tdf AS (SELECT repeat, fold, feature, count(*) AS df FROM trc GROUP BY ALL),
fre AS (SELECT trc.repeat, trc.fold, trc.label, trc.feature, sum((1 + log10(trc.n)) * log10(ntr.nd / tdf.df)) AS frequency
        FROM trc JOIN tdf ON tdf.repeat = trc.repeat AND tdf.fold = trc.fold AND tdf.feature = trc.feature
        JOIN ntr ON ntr.repeat = trc.repeat AND ntr.fold = trc.fold GROUP BY ALL),
sel AS MATERIALIZED (SELECT DISTINCT repeat, fold, feature FROM (SELECT *, rank() OVER (PARTITION BY repeat, fold, label
        ORDER BY round(frequency, 6) DESC) AS r FROM fre) WHERE r <= {top}),"""


def nb_cv_sql(counts_sql: str, docs_sql: str, k=10, seed=1, repeats=1, smoothings=(1.0,), train_top=None) -> str:
    """CTE chain ending in ``pred(repeat, smoothing, fold, doc_id, actual, predicted)``;
    also defines ``cls(label)``.  ``train_top``: features are selected anew on
    the training documents of every fold."""
    if train_top is None:
        select, seen, v_cols, v_on = "", "", "count(DISTINCT feature) AS v FROM counts", "CROSS JOIN vv"
        seen_train = ""
    else:
        select = _train_selection_sql(train_top)
        seen_train = "JOIN sel ON sel.repeat = fl.repeat AND sel.fold = fl.fold AND sel.feature = c.feature"
        seen = "JOIN sel ON sel.repeat = dd.repeat AND sel.fold = dd.fold AND sel.feature = c.feature"
        v_cols = "repeat, fold, count(*) AS v FROM sel GROUP BY ALL"
        v_on = "JOIN vv ON vv.repeat = dd.repeat AND vv.fold = dd.fold"
    sm = ", ".join(f"CAST({float(s)} AS DOUBLE)" for s in smoothings)
    ninf = "CAST('-inf' AS DOUBLE)"
    return f"""
counts AS ({counts_sql}),
docs AS (SELECT doc_id, label FROM ({docs_sql})),
folds AS ({folds_sql(docs_sql, k, seed, repeats)}),
sm AS (SELECT unnest([{sm}]) AS s),
cls AS (SELECT DISTINCT label FROM docs),
fl AS (SELECT DISTINCT repeat, fold FROM folds),
dd AS (SELECT d.doc_id, d.label, f.repeat, f.fold FROM docs d JOIN folds f ON d.doc_id = f.doc_id),{select}
vv AS (SELECT {v_cols}),
trn AS (SELECT fl.repeat, fl.fold, c.label, c.feature, sum(c.n) AS n
        FROM counts c JOIN dd ON c.doc_id = dd.doc_id JOIN fl ON dd.repeat = fl.repeat AND dd.fold <> fl.fold {seen_train} GROUP BY ALL),
tdocs AS (SELECT fl.repeat, fl.fold, cls.label, count(dd.doc_id) AS nd
          FROM fl CROSS JOIN cls LEFT JOIN dd ON dd.repeat = fl.repeat AND dd.fold <> fl.fold AND dd.label = cls.label GROUP BY ALL),
prior AS (SELECT repeat, fold, label, nd / sum(nd) OVER (PARTITION BY repeat, fold) AS prior FROM tdocs),
ttot AS (SELECT fl.repeat, fl.fold, cls.label, coalesce(sum(trn.n), 0) AS t
         FROM fl CROSS JOIN cls LEFT JOIN trn ON trn.repeat = fl.repeat AND trn.fold = fl.fold AND trn.label = cls.label GROUP BY ALL),
tc AS (SELECT dd.doc_id, dd.repeat, dd.fold, c.feature, c.n FROM dd JOIN counts c ON c.doc_id = dd.doc_id {seen}),
sl AS (SELECT tc.doc_id, tc.repeat, tc.fold, cls.label, sm.s,
              sum(tc.n * CASE WHEN coalesce(trn.n, 0) + sm.s > 0 THEN ln(coalesce(trn.n, 0) + sm.s) ELSE {ninf} END) AS sl,
              sum(tc.n) AS dlen
       FROM tc CROSS JOIN cls CROSS JOIN sm
       LEFT JOIN trn ON trn.repeat = tc.repeat AND trn.fold = tc.fold AND trn.label = cls.label AND trn.feature = tc.feature
       GROUP BY ALL),
sc AS (SELECT dd.doc_id, dd.repeat, dd.fold, dd.label AS actual, cls.label, sm.s, p.prior,
              CASE WHEN p.prior > 0 THEN ln(p.prior) ELSE {ninf} END + coalesce(sl.sl, 0)
              - coalesce(sl.dlen, 0) * CASE WHEN t.t + sm.s * vv.v > 0 THEN ln(t.t + sm.s * vv.v) ELSE {ninf} END AS score
       FROM dd CROSS JOIN cls CROSS JOIN sm {v_on}
       JOIN prior p ON p.repeat = dd.repeat AND p.fold = dd.fold AND p.label = cls.label
       JOIN ttot t ON t.repeat = dd.repeat AND t.fold = dd.fold AND t.label = cls.label
       LEFT JOIN sl ON sl.doc_id = dd.doc_id AND sl.repeat = dd.repeat AND sl.label = cls.label AND sl.s = sm.s),
pred AS (SELECT repeat, s AS smoothing, fold, doc_id, actual, label AS predicted FROM (
           SELECT *, row_number() OVER (PARTITION BY repeat, s, doc_id ORDER BY round(score, 6) DESC, prior DESC, label) AS rn
           FROM sc) WHERE rn = 1)"""


def confusion_sql(keys: list[str], pred="pred") -> str:
    k = ", ".join(keys)
    on = " AND ".join(f"g.{x} = c.{x}" for x in keys)
    return f"""
kk AS (SELECT DISTINCT {k} FROM {pred}),
grid AS (SELECT kk.*, a.label AS actual, p.label AS predicted FROM kk CROSS JOIN cls a CROSS JOIN cls p),
cnt AS (SELECT {k}, actual, predicted, count(*) AS n FROM {pred} GROUP BY ALL),
conf AS (SELECT g.*, CAST(coalesce(c.n, 0) AS BIGINT) AS n FROM grid g LEFT JOIN cnt c
         ON {on} AND g.actual = c.actual AND g.predicted = c.predicted)"""


def class_metrics_sql(keys: list[str]) -> str:
    k = ", ".join(keys)
    on = " AND ".join(f"a.{x} = p.{x}" for x in keys)
    return f"""
byact AS (SELECT {k}, actual AS label, CAST(sum(n) AS BIGINT) AS support,
                 CAST(sum(CASE WHEN actual = predicted THEN n ELSE 0 END) AS BIGINT) AS tp FROM conf GROUP BY ALL),
bypred AS (SELECT {k}, predicted AS label, CAST(sum(n) AS BIGINT) AS n_predicted FROM conf GROUP BY ALL),
cm0 AS (SELECT a.*, p.n_predicted,
               CASE WHEN p.n_predicted = 0 THEN NULL ELSE a.tp / p.n_predicted END AS precision,
               CASE WHEN a.support = 0 THEN NULL ELSE a.tp / a.support END AS recall
        FROM byact a JOIN bypred p ON {on} AND a.label = p.label),
cm AS (SELECT *, CASE WHEN precision + recall = 0 THEN NULL ELSE 2 * precision * recall / (precision + recall) END AS f1 FROM cm0)"""


def fold_metrics_sql(keys: list[str]) -> str:
    k = ", ".join(keys)
    return f"""
fm0 AS (SELECT {k},
               CASE WHEN count(f1) = count(*) THEN avg(f1) END AS macro,
               sum(tp) AS tp, sum(support) AS n, sum(n_predicted) AS np,
               CASE WHEN count(CASE WHEN support > 0 AND f1 IS NULL THEN 1 END) = 0
                    THEN sum(CASE WHEN support > 0 THEN f1 * support END) / sum(support) END AS weighted
        FROM cm GROUP BY ALL),
fm AS (SELECT {k}, coalesce(macro, 0.0) AS macro_f1,
              coalesce(CASE WHEN tp = 0 THEN NULL ELSE 2 * (tp / np) * (tp / n) / ((tp / np) + (tp / n)) END, 0.0) AS micro_f1,
              coalesce(weighted, 0.0) AS weighted_f1 FROM fm0)"""
