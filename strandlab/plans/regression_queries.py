"""Queries on motif regression and its tables. Fits have no SQL form; the tests check laws and planted motifs."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandlab.operators import plots
from strandlab.operators import regression as G
from strandlab.operators.stats import least_squares, r_squared
from strandlab.plans.data import ORDER_DNA, order_dna
from strandlab.plans.scoring_queries import energy_ctes, lse, motif
from strandlab.sources import motifs as M

QUERIES, SQL = {}, {}
OPTIONS = G.Options(motif_length=9, spat_num_bins=3, spat_bin_size=20)


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def planted(spark, d):
    """Orders' DNA with responses that follow two words in the sequence."""
    df = order_dna(spark, d)
    return df.withColumn("y", F.col("seq").contains("GATTA").cast("int")).withColumn("z", F.col("price") / 1e5 + 4 * F.col("y") + 2 * F.col("seq").contains("CCGTC").cast("int"))


def _rows(spark, model: G.MotifModel, name: str):
    return model.table(spark, name).withColumns({"consensus": F.lit(model.consensus), "score": F.lit(float(model.score))})


@query("regress_pwm_seed")
def _(spark, d):
    return _rows(spark, G.regress_pwm(planted(spark, d), "z", "GATTA", OPTIONS), "seed")


@query("regress_pwm")
def _(spark, d):
    return _rows(spark, G.regress_pwm(planted(spark, d), "z", options=OPTIONS, motif_dataset=M.library(spark)), "multi_kmers")


@query("regress_pwm_pssm_init")
def _(spark, d):
    return _rows(spark, G.regress_pwm(planted(spark, d), "z", options=OPTIONS, motif_dataset=M.library(spark), init_from_dataset=True), "dataset")


@query("regress_pwm_ks")
def _(spark, d):
    from dataclasses import replace

    return _rows(spark, G.regress_pwm(planted(spark, d), "y", "GATTA", replace(OPTIONS, score_metric="ks")), "ks")


@query("regress_pwm_sample")
def _(spark, d):
    return _rows(spark, G.regress_pwm_sample(planted(spark, d), "y", motif="GATTA", options=OPTIONS), "sample")


@query("regress_pwm_clusters")
def _(spark, d):
    df = planted(spark, d).withColumn("cluster", F.when(F.col("y") == 1, "word").otherwise("rest"))
    parts = [_rows(spark, m, c) for c, m in G.regress_pwm_clusters(df, "cluster", OPTIONS, motif="GATTA").items()]
    return parts[0].unionByName(parts[1])


@query("regress_pwm_cv")
def _(spark, d):
    out = G.regress_pwm_cv(planted(spark, d), "z", 3, options=OPTIONS, motif="GATTA", add_full_model=False)
    return out["predictions"].select("seq_id", "fold", "pred")


@query("regress_multiple_motifs")
def _(spark, d):
    multi = G.regress_multiple_motifs(planted(spark, d), "z", 2, options=OPTIONS)
    return spark.createDataFrame([(s["model"], s["score"], s["comb_score"], s["diff"], s["consensus"]) for s in multi.stats], "model int, score double, comb_score double, diff double, consensus string")


@query("model_predict")
def _(spark, d):
    df = planted(spark, d)
    return G.regress_pwm(df, "z", "GATTA", OPTIONS).transform(df).select("seq_id", "pred")


_SPAT = ((0.5, 1.0, 2.0), 20)
_FIXED = energy_ctes(ORDER_DNA + ", cut AS (SELECT seq_id, substr(seq, 1, 60) AS seq FROM orders_dna)", "cut", ["GATA"], spat=_SPAT)


def fixed_model() -> G.MotifModel:
    """A motif and spatial factors that are given, not fitted."""
    import numpy as np

    p = np.array([r[2:] for r in M.rows(["GATA"])], float)
    return G.MotifModel((p / p.sum(1, keepdims=True) + 0.01) / 1.04, _SPAT[0], _SPAT[1], 0, 60)


@query("fixed_model_predict", f"WITH {_FIXED}, e AS ({lse('seq_id')}) SELECT seq_id, pwm AS pred FROM e")
def _(spark, d):
    return fixed_model().transform(order_dna(spark, d)).select("seq_id", "pred")


@query("fixed_model_score", f"WITH {_FIXED}, e AS ({lse('seq_id')}) SELECT pow(corr(pwm, price), 2) AS r2, regr_intercept(price, pwm) AS intercept, regr_slope(price, pwm) AS slope FROM e JOIN orders_dna USING (seq_id)")
def _(spark, d):
    df = order_dna(spark, d)
    model = G.scored(df, fixed_model(), ["price"], OPTIONS, False)
    multi = G.MultiModel([model], least_squares(model.transform(df, "e1"), ["e1"], ["price"]), ["price"], [])
    return spark.createDataFrame([(float(model.r2["price"]), *map(float, multi.coefficients[:, 0]))], "r2 double, intercept double, slope double")


@query("fixed_model_moments", f"""WITH {_FIXED}, b AS (SELECT seq_id, CAST(floor((i - 1) / 20) AS INTEGER) AS bin, sum(exp(s) / (CASE CAST(floor((i - 1) / 20) AS INTEGER) WHEN 0 THEN 0.5 WHEN 1 THEN 1.0 ELSE 2.0 END)) AS share FROM w GROUP BY ALL)
SELECT bin, sum(share) AS total, sum(share * price) AS with_price FROM b JOIN orders_dna USING (seq_id) GROUP BY bin""")
def _(spark, d):
    """What one step of a fit sums for the spatial factors: by bin, the energy and its product with the response."""
    import numpy as np

    from strandlab.functions.sequence import trimmed

    model = fixed_model()
    df = order_dna(spark, d).withColumn("seq", trimmed(F.col("seq"), 1, 60))
    sums = G.SparkSums(df, ["price"], 1)
    windows = 60 - len(model.pssm) + 1
    v = sums(G.Request(model.pssm, np.array(model.spat), G.bin_of(windows, 20, 3, False), True, "gram"))
    sums.close()
    tail = v[-(3 + 9 + 3) :]  # energies, their products, their products with the response
    return spark.createDataFrame([(i, float(tail[i]), float(tail[12 + i])) for i in range(3)], "bin int, total double, with_price double")


#: The 20 moves of a step, by their number: each base up and down alone, then pairs up and pairs down.
_MOVES = """moves(m, dA, dC, dG, dT) AS (VALUES (0, 1, 0, 0, 0), (1, -1, 0, 0, 0), (2, 0, 1, 0, 0), (3, 0, -1, 0, 0), (4, 0, 0, 1, 0), (5, 0, 0, -1, 0), (6, 0, 0, 0, 1), (7, 0, 0, 0, -1),
  (8, 1, 1, 0, 0), (9, 1, 0, 1, 0), (10, 1, 0, 0, 1), (11, -1, -1, 0, 0), (12, -1, 0, -1, 0), (13, -1, 0, 0, -1), (14, 0, 1, 1, 0), (15, 0, 1, 0, 1), (16, 0, -1, -1, 0), (17, 0, -1, 0, -1), (18, 0, 0, 1, 1), (19, 0, 0, -1, -1))"""


def step_ctes(matrix: str, letters: str, response: str, step: float, n: str = "", factor: str = "1.0") -> str:
    """CTE ``score``: (k, m, r2) of every move from the matrix (k, pA, pC, pG, pT) against ``response`` (seq_id, y).

    ``letters``: (seq_id, loc, b, n). A window's product without one position's factor is that position's
    share of the derivative; ``factor`` is the spatial factor of the window that begins at ``i`` (from 1).
    """
    return f"""strands{n} AS (SELECT 0 AS strand, k AS j, k, pA, pC, pG, pT FROM {matrix} UNION ALL SELECT 1, (SELECT count(*) FROM {matrix}) - 1 - k, k, pT, pG, pC, pA FROM {matrix}),
f{n} AS (SELECT seq_id, loc - j AS i, strand, k, CASE WHEN strand = 0 THEN b ELSE translate(b, 'ACGT', 'TGCA') END AS own, CASE b WHEN 'A' THEN pA WHEN 'C' THEN pC WHEN 'G' THEN pG ELSE pT END AS p
      FROM {letters}, strands{n} WHERE loc - j >= 1 AND loc - j + (SELECT count(*) FROM {matrix}) - 1 <= n),
win{n} AS (SELECT seq_id, i, strand, exp(sum(ln(p))) * {factor} AS e FROM f{n} GROUP BY seq_id, i, strand),
d{n} AS (SELECT seq_id, k, sum(CASE WHEN own = 'A' THEN e / p ELSE 0 END) AS tA, sum(CASE WHEN own = 'C' THEN e / p ELSE 0 END) AS tC, sum(CASE WHEN own = 'G' THEN e / p ELSE 0 END) AS tG, sum(CASE WHEN own = 'T' THEN e / p ELSE 0 END) AS tT
      FROM f{n} JOIN win{n} USING (seq_id, i, strand) GROUP BY seq_id, k),
cand{n} AS (SELECT k, m, {", ".join(f"CASE WHEN d{c} <> 0 AND p{c} + {step} * d{c} <= 0 THEN 0.001::DOUBLE ELSE p{c} + {step}::DOUBLE * d{c} END AS q{c}" for c in "ACGT")}, {", ".join(f"greatest(p{c} + {step}::DOUBLE * d{c}, CASE WHEN d{c} <> 0 THEN 0.001::DOUBLE ELSE 0 END) AS n{c}" for c in "ACGT")} FROM {matrix}, moves),
score{n} AS (SELECT k, m, coalesce(pow(corr(qA * tA + qC * tC + qG * tG + qT * tT, y), 2), 0) AS r2 FROM cand{n} JOIN d{n} USING (k) JOIN {response} USING (seq_id) GROUP BY k, m)"""


_LETTERS = "letters AS (SELECT seq_id, generate_subscripts(string_split(seq, ''), 1) AS loc, unnest(string_split(seq, '')) AS b, length(seq) AS n FROM cut)"
_CUT = "cut AS (SELECT seq_id, substr(seq, 1, 60) AS seq FROM orders_dna)"
_GIVEN = "given AS (SELECT CAST(pos AS BIGINT) AS k, " + ", ".join(f"({c} / (A + C + G + T) + CAST(0.01 AS DOUBLE)) / CAST(1.04 AS DOUBLE) AS p{c}" for c in "ACGT") + " FROM m)"
_BIN_FACTOR = "(CASE CAST(floor((i - 1) / 20) AS INTEGER) WHEN 0 THEN 0.5 WHEN 1 THEN 1.0 ELSE 2.0 END)::DOUBLE"


@query("regress_step_scores", f"""WITH {ORDER_DNA}, {_CUT}, {_LETTERS}, {M.values_sql(["GATA"])}, {_GIVEN}, {_MOVES}, priced AS (SELECT seq_id, price AS y FROM orders_dna),
{step_ctes("given", "letters", "priced", 0.05, factor=_BIN_FACTOR)} SELECT CAST(k AS INTEGER) AS pos, CAST(m AS INTEGER) AS move, r2 FROM score""")
def _(spark, d):
    """What one step of a fit chooses from: every move of every position."""
    from dataclasses import replace

    scores = G.step_scores(order_dna(spark, d), "price", fixed_model(), 0.05, replace(OPTIONS, symmetrize_spat=False))
    return spark.createDataFrame(scores, "pos int, move int, r2 double")


def _moved(n: int) -> str:
    """The best move of step n and the matrix after it."""
    before = "start" if n == 1 else f"matrix{n - 1}"
    total = "(nA + nC + nG + nT)"
    after = ", ".join(f"CASE WHEN b.m IS NULL THEN p.p{c} ELSE b.n{c} / {total} END AS p{c}" for c in "ACGT")
    return f"""{step_ctes(before, "letters", "planted", 0.05, str(n))},
best{n} AS (SELECT * FROM score{n} JOIN cand{n} USING (k, m) ORDER BY r2 DESC, k, m LIMIT 1),
matrix{n} AS (SELECT p.k, {after} FROM {before} p LEFT JOIN best{n} b USING (k))"""


@query("regress_first_moves", f"""WITH {ORDER_DNA}, {_CUT}, {_LETTERS}, {_MOVES},
planted AS (SELECT seq_id, price / 1e5 + 4 * CAST(contains(seq, 'GATTA') AS INTEGER) + 2 * CAST(contains(seq, 'CCGTC') AS INTEGER) AS y FROM orders_dna),
start(k, pA, pC, pG, pT) AS (SELECT k, CASE b WHEN 'A' THEN 0.85 WHEN 'N' THEN 0.25 ELSE 0.05 END::DOUBLE, CASE b WHEN 'C' THEN 0.85 WHEN 'N' THEN 0.25 ELSE 0.05 END::DOUBLE, CASE b WHEN 'G' THEN 0.85 WHEN 'N' THEN 0.25 ELSE 0.05 END::DOUBLE, CASE b WHEN 'T' THEN 0.85 WHEN 'N' THEN 0.25 ELSE 0.05 END::DOUBLE
  FROM (SELECT generate_subscripts(string_split('NGATTAN', ''), 1) - 1 AS k, unnest(string_split('NGATTAN', '')) AS b)),
{_moved(1)}, {_moved(2)}, {_moved(3)}
SELECT CAST(step AS INTEGER) AS step, CAST(k AS INTEGER) AS pos, CAST(m AS INTEGER) AS move, r2 FROM (SELECT 1 AS step, k, m, r2 FROM best1 UNION ALL SELECT 2, k, m, r2 FROM best2 UNION ALL SELECT 3, k, m, r2 FROM best3)""")
def _(spark, d):
    """The first three moves of a fit of the matrix from a k-mer, step by step."""
    from dataclasses import replace

    from strandlab.functions.sequence import trimmed

    o = replace(OPTIONS, motif_length=7, optimize_spat=False, symmetrize_spat=False, max_steps=3)
    sums = G.SparkSums(planted(spark, d).withColumn("seq", trimmed(F.col("seq"), 1, 60)), ["z"], 1)
    trace: list = []
    G.fit_together(sums, [G.search(G.seed_matrix("GATTA", 7, 0.05), o, 60, 1, trace=trace)])
    sums.close()
    return spark.createDataFrame(trace, "step int, pos int, move int, r2 double")


@query("candidate_kmers")
def _(spark, d):
    from strandlab.functions.kmers import candidate_kmers

    return spark.createDataFrame([(k,) for k in candidate_kmers(planted(spark, d), ["z"], [5], 0, 0)], "kmer string")


@query("least_squares", f"WITH {energy_ctes(ORDER_DNA, 'orders_dna', ['GATA'])}, e AS ({lse('seq_id')}) SELECT round(regr_intercept(price, pwm), 2) AS intercept, round(regr_slope(price, pwm), 2) AS slope FROM e JOIN orders_dna USING (seq_id)")
def _(spark, d):
    from strandlab.operators.scoring import compute_pwm

    c = least_squares(compute_pwm(order_dna(spark, d), motif("GATA")), ["pwm"], ["price"])
    return spark.createDataFrame([(round(float(c[0, 0]), 2), round(float(c[1, 0]), 2))], "intercept double, slope double")


@query("r_squared", f"WITH {ORDER_DNA} SELECT priority, pow(corr(price, seq_id), 2) AS r2 FROM orders_dna GROUP BY priority")
def _(spark, d):
    return order_dna(spark, d).groupBy("priority").agg(r_squared(F.col("price"), F.col("seq_id")).alias("r2"))


@query("interpolate", f"WITH {ORDER_DNA} SELECT seq_id, CASE WHEN price <= 1000 THEN 0.0 WHEN price >= 400000 THEN 2.0 WHEN price < 100000 THEN (price - 1000) / 99000 ELSE 1 + (price - 100000) / 300000 END AS v FROM orders_dna")
def _(spark, d):
    return order_dna(spark, d).select("seq_id", G.interpolated(F.col("price"), [1000, 100000, 400000], [0, 1, 2]).alias("v"))


@query("prediction_curves", f"WITH {ORDER_DNA}, c AS (SELECT CAST(contains(seq, 'GATTA') AS INTEGER) AS response, price AS pred, count(*) AS n FROM orders_dna GROUP BY ALL), a AS (SELECT response, pred, 1 - sum(n) OVER (PARTITION BY response ORDER BY pred) / CAST(sum(n) OVER (PARTITION BY response) AS DOUBLE) AS above FROM c), g AS (SELECT pred, sum(CASE WHEN response = 1 THEN n ELSE 0 END) AS c1, sum(CASE WHEN response = 0 THEN n ELSE 0 END) AS c0 FROM c GROUP BY pred), k AS (SELECT max(d) AS d FROM (SELECT abs(sum(c1) OVER (ORDER BY pred) / CAST(sum(c1) OVER () AS DOUBLE) - sum(c0) OVER (ORDER BY pred) / CAST(sum(c0) OVER () AS DOUBLE)) AS d FROM g)) SELECT a.*, d FROM a, k")
def _(spark, d):
    return plots.prediction_curves(planted(spark, d), "price", "y")


@query("spatial_model", f"WITH {ORDER_DNA}, f AS (SELECT CAST(floor((strpos(seq, 'GAT') - 1) / 20) AS INTEGER) AS bin, count(*) AS n FROM orders_dna WHERE strpos(seq, 'GAT') BETWEEN 1 AND 60 GROUP BY 1) SELECT CAST(i * 20 AS INTEGER) AS bin, coalesce(n, 0) / CAST(sum(coalesce(n, 0)) OVER () AS DOUBLE) AS spat_factor FROM range(0, 3) r(i) LEFT JOIN f ON f.bin = i")
def _(spark, d):
    """Factors from where a word stands first in the orders' DNA."""
    import numpy as np

    at = F.instr("seq", "GAT")
    counted = order_dna(spark, d).where(at.between(1, 60)).groupBy(F.floor((at - 1) / 20).cast("int").alias("bin")).count()
    n = {r.bin: r["count"] for r in counted.collect()}
    factors = tuple(n.get(b, 0) / sum(n.values()) for b in range(3))
    return plots.spatial_model(spark, G.MotifModel(np.full((4, 4), 0.25), factors, 20, 0, 60))
