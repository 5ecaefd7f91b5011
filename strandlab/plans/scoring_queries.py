"""Queries on scoring and screening, with their SQL (the relational form of the energy)."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import functions as F

from strandlab.functions import pssm as P
from strandlab.functions.sequence import dna_of_id
from strandlab.operators import screening as R
from strandlab.operators import scoring as E
from strandlab.operators import stats
from strandlab.operators.session import shared_dir
from strandlab.plans.data import DOC_DNA, LABELLED_DNA, ORDER_DNA, counted_motifs, counted_sql, doc_dna, labelled_dna, order_dna
from strandlab.sources import motifs as M
from strandlab.streaming import screening

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def motif(name: str, prior: float = 0.01) -> E.Motif:
    return E.Motif.of(name, np.array([r[2:] for r in M.rows([name])]), prior)


def motifs(*names: str, prior: float = 0.01) -> list[E.Motif]:
    return [motif(n, prior) for n in sorted(names or M.LIBRARY)]


ALL = sorted(M.LIBRARY)


def energy_ctes(source: str, table: str, names: list[str], bidirect: bool = True, spat: tuple[tuple[float, ...], int] | None = None) -> str:
    """CTE ``w``: (seq_id, motif, i, strand, s) with s the log score of the window that begins at i (from 1)."""
    p = ", ".join(f"ln(({c} / (A + C + G + T) + CAST(0.01 AS DOUBLE)) / CAST(1.04 AS DOUBLE)) AS l{c}" for c in "ACGT")
    factor = ""
    limit = ""
    if spat:
        factors, size = spat
        factor = " + ln(CASE CAST(floor((loc - k - 1) / %d) AS INTEGER) %s END)" % (size, " ".join(f"WHEN {b} THEN CAST({f} AS DOUBLE)" for b, f in enumerate(factors)))
        limit = f" AND loc - k <= {len(factors) * size}"
    reverse = "UNION ALL SELECT motif, 1 AS strand, len, len - 1 - k AS k, lT AS lA, lG AS lC, lC AS lG, lA AS lT FROM l" if bidirect else ""
    return f"""{source}, {M.values_sql(names)},
l AS (SELECT motif, row_number() OVER (PARTITION BY motif ORDER BY pos) - 1 AS k, count(*) OVER (PARTITION BY motif) AS len, {p} FROM m),
st AS (SELECT motif, 0 AS strand, len, k, lA, lC, lG, lT FROM l {reverse}),
c AS (SELECT seq_id, length(seq) AS n, generate_subscripts(string_split(seq, ''), 1) AS loc, unnest(string_split(seq, '')) AS b FROM {table} WHERE seq <> ''),
w AS (SELECT seq_id, motif, loc - k AS i, strand, sum(CASE b WHEN 'A' THEN lA WHEN 'C' THEN lC WHEN 'G' THEN lG ELSE lT END){factor} AS s
      FROM c JOIN st ON loc - k >= 1 AND loc - k + len - 1 <= n WHERE true{limit} GROUP BY seq_id, motif, loc - k, strand)"""


_LSE = "max(s) + ln(sum(exp(s - mx)))"


def lse(keys: str, source: str = "w") -> str:
    return f"SELECT {keys}, max(mx) + ln(sum(exp(s - mx))) AS pwm FROM (SELECT *, max(s) OVER (PARTITION BY {keys}) AS mx FROM {source}) GROUP BY {keys}"


@query("compute_pwm", f"WITH {energy_ctes(ORDER_DNA, 'orders_dna', ['TATA'])}, e AS ({lse('seq_id')}) SELECT * FROM e")
def _(spark, d):
    return E.compute_pwm(order_dna(spark, d), motif("TATA")).select("seq_id", "pwm")


@query("compute_pwm_one_strand", f"WITH {energy_ctes(ORDER_DNA, 'orders_dna', ['GATA'], bidirect=False)}, e AS ({lse('seq_id')}) SELECT * FROM e")
def _(spark, d):
    return E.compute_pwm(order_dna(spark, d), motif("GATA"), bidirect=False).select("seq_id", "pwm")


@query("compute_pwm_max", f"WITH {energy_ctes(ORDER_DNA, 'orders_dna', ['GATA'])}, e AS ({lse('seq_id, i')}) SELECT seq_id, max(pwm) AS pwm FROM e GROUP BY seq_id")
def _(spark, d):
    return E.compute_pwm(order_dna(spark, d), motif("GATA"), func="max").select("seq_id", "pwm")


_SPAT = ((0.5, 1.0, 2.0, 1.0, 0.5), 12)


@query("compute_pwm_spatial", f"WITH {energy_ctes(ORDER_DNA, 'orders_dna', ['EBOX'], spat=_SPAT)}, e AS ({lse('seq_id')}) SELECT * FROM e")
def _(spark, d):
    return E.compute_pwm(order_dna(spark, d), motif("EBOX"), spat=E.Spatial(*_SPAT)).select("seq_id", "pwm")


@query("compute_pwm_range", f"WITH {energy_ctes(ORDER_DNA + ', part AS (SELECT seq_id, substr(seq, 9, 40) AS seq FROM orders_dna)', 'part', ['EBOX'])}, e AS ({lse('seq_id')}) SELECT * FROM e")
def _(spark, d):
    return E.compute_pwm(order_dna(spark, d), motif("EBOX"), spat_min=9, spat_max=48).select("seq_id", "pwm")


@query("compute_pwm_native", f"WITH {energy_ctes(DOC_DNA, 'docs_dna', ['GATA'])}, e AS ({lse('seq_id')}) SELECT seq_id, pwm FROM docs_dna LEFT JOIN e USING (seq_id)")
def _(spark, d):
    return doc_dna(spark, d).select("seq_id", E.native_energy(F.col("seq"), motif("GATA")).alias("pwm"))


@query("extract_pwm", f"WITH {energy_ctes(DOC_DNA, 'docs_dna', ALL)}, e AS ({lse('seq_id, motif')}) SELECT seq_id, motif, pwm FROM docs_dna CROSS JOIN (SELECT DISTINCT motif FROM m) LEFT JOIN e USING (seq_id, motif)")
def _(spark, d):
    return E.extract_pwm(doc_dna(spark, d), motifs())


@query("calc_seq_pwm", f"WITH {energy_ctes(ORDER_DNA, 'orders_dna', ['EBOX', 'GATA'])}, e AS ({lse('seq_id, motif')}) SELECT seq_id, max(pwm) FILTER (motif = 'EBOX') AS EBOX, max(pwm) FILTER (motif = 'GATA') AS GATA FROM e GROUP BY seq_id")
def _(spark, d):
    return E.score_matrix(order_dna(spark, d), motifs("EBOX", "GATA"))


_WITH_N = "masked AS (SELECT seq_id, CASE WHEN seq_id % 5 = 0 THEN substr(seq, 1, 9) || 'N' || substr(seq, 11) ELSE seq END AS seq FROM orders_dna)"


@query("calc_seq_pwm_unknown", f"WITH {energy_ctes(ORDER_DNA + ', ' + _WITH_N, 'masked', ALL)}, e AS ({lse('seq_id, motif')}) SELECT seq_id, motif, CASE WHEN seq_id % 5 <> 0 THEN pwm END AS pwm FROM e")
def _(spark, d):
    """A sequence with an unknown letter has no score."""
    masked = F.when(F.col("seq_id") % 5 == 0, F.concat(F.substring("seq", 1, 9), F.lit("N"), F.substring("seq", 11, 64))).otherwise(F.col("seq"))
    return E.extract_pwm(order_dna(spark, d).withColumn("seq", masked), motifs())


@query("compute_local_pwm", f"WITH {energy_ctes(DOC_DNA, 'docs_dna', ['SPEC'])}, e AS ({lse('seq_id, i')}), p AS (SELECT seq_id, CAST(loc AS BIGINT) AS pos FROM c) SELECT p.seq_id, p.pos, pwm FROM p LEFT JOIN e ON e.seq_id = p.seq_id AND e.i = p.pos")
def _(spark, d):
    scored = E.compute_local_pwm(doc_dna(spark, d), motif("SPEC"))
    return scored.select("seq_id", F.posexplode("local").alias("p", "pwm")).select("seq_id", (F.col("p") + 1).cast("bigint").alias("pos"), "pwm")


@query("screen_local_pwm", f"WITH {energy_ctes(DOC_DNA, 'docs_dna', ['SPEC'])}, e AS ({lse('seq_id, i')}) SELECT seq_id, CAST(i AS BIGINT) AS pos FROM e WHERE pwm > -6.5")
def _(spark, d):
    hits = E.screen_local_pwm(doc_dna(spark, d), motif("SPEC"), ">", -6.5)
    return hits.select("seq_id", F.explode("positions").alias("pos")).select("seq_id", F.col("pos").cast("bigint").alias("pos"))


@query("best_position", f"WITH {energy_ctes(DOC_DNA, 'docs_dna', ['GATA'])}, e AS ({lse('seq_id, i')}), b AS (SELECT seq_id, CAST(arg_max(i, (round(pwm, 9), -i)) AS INTEGER) AS best FROM e GROUP BY seq_id) SELECT d.seq_id, coalesce(best, 0) AS best FROM docs_dna d LEFT JOIN b ON b.seq_id = d.seq_id")
def _(spark, d):
    return E.best_position(doc_dna(spark, d), motif("GATA")).select("seq_id", F.coalesce("best", F.lit(0)).alias("best"))  # 0: no window fits


@query(
    "mask_sequences",
    f"""WITH {energy_ctes(DOC_DNA, 'docs_dna', ['SPEC'])}, e AS ({lse('seq_id, i')}),
hit AS (SELECT DISTINCT e.seq_id, i + k AS loc FROM e JOIN docs_dna d ON e.seq_id = d.seq_id, range(0, 4) r(k) WHERE pwm > -6.5 AND i < length(seq) - 3),
k AS (SELECT c.seq_id, string_agg(CASE WHEN hit.loc IS NOT NULL OR c.loc > n - 4 THEN 'N' ELSE b END, '' ORDER BY c.loc) AS masked FROM c LEFT JOIN hit ON hit.seq_id = c.seq_id AND hit.loc = c.loc GROUP BY c.seq_id)
SELECT d.seq_id, coalesce(masked, '') AS masked FROM docs_dna d LEFT JOIN k ON k.seq_id = d.seq_id""",
)
def _(spark, d):
    bits = [True] * 4  # all four positions of this motif are informative
    return E.mask_sequences(doc_dna(spark, d), motif("SPEC"), -6.5, bits).select("seq_id", "masked")


_R2 = "CASE WHEN var_pop(pwm) > 0 AND var_pop({y}) > 0 THEN pow(covar_pop(pwm, {y}), 2) / (var_pop(pwm) * var_pop({y})) END"


@query("screen_pwm_r2", f"WITH {energy_ctes(ORDER_DNA, 'orders_dna', ['EBOX', 'GATA', 'SPEC'])}, e AS ({lse('seq_id, motif')}) SELECT motif, {_R2.format(y='price')} AS score FROM e JOIN orders_dna USING (seq_id) GROUP BY motif")
def _(spark, d):
    return R.screen_pwm(order_dna(spark, d), "price", motifs("EBOX", "GATA", "SPEC"))


@query("screen_stream", f"WITH {energy_ctes(ORDER_DNA, 'orders_dna', ['EBOX', 'GATA', 'SPEC'])}, e AS ({lse('seq_id, motif')}) SELECT motif, {_R2.format(y='price')} AS score, count(*) AS n FROM e JOIN orders_dna USING (seq_id) GROUP BY motif")
def _(spark, d):
    """The orders as a stream, screened batch by batch."""
    source = f"{d}/orders.parquet"
    orders = spark.readStream.schema(spark.read.parquet(source).schema).option("maxFilesPerTrigger", 1).parquet(f"{d}/orders.parque[t]")  # a pattern may name a single file
    stream = orders.select(F.col("o_orderkey").cast("bigint").alias("seq_id"), dna_of_id(F.col("o_orderkey")).alias("seq"), F.col("o_totalprice").cast("double").alias("price"))
    path = f"{shared_dir(spark)}/screen-{uuid.uuid4().hex}"
    screening.write_screen(screening.screen_stream(stream, "price", motifs("EBOX", "GATA", "SPEC")), path, f"{path}-checkpoint").awaitTermination()
    return spark.read.parquet(path)


_RUN = """g AS (SELECT motif, {extra}pwm, sum(CASE WHEN y = 1 THEN 1 ELSE 0 END) AS c1, sum(CASE WHEN y = 0 THEN 1 ELSE 0 END) AS c0 FROM {source} GROUP BY ALL),
r AS (SELECT motif, {extra}sum(c1) OVER v AS r1, sum(c0) OVER v AS r0, sum(c1) OVER u AS n1, sum(c0) OVER u AS n0 FROM g
      WINDOW v AS (PARTITION BY motif{part} ORDER BY pwm ROWS UNBOUNDED PRECEDING), u AS (PARTITION BY motif{part}))"""


@query("screen_pwm_ks", f"WITH {energy_ctes(LABELLED_DNA, 'labelled', ALL)}, e AS ({lse('seq_id, motif')}), x AS (SELECT motif, round(pwm, 9) AS pwm, y FROM e JOIN labelled USING (seq_id)), {_RUN.format(extra='', source='x', part='')} SELECT motif, max(abs(r1 / CAST(n1 AS DOUBLE) - r0 / CAST(n0 AS DOUBLE))) AS score FROM r GROUP BY motif")
def _(spark, d):
    return R.screen_pwm(labelled_dna(spark, d), "y", motifs())


@query("ks_distance", f"WITH {energy_ctes(LABELLED_DNA, 'labelled', ['GATA'])}, e AS ({lse('seq_id, motif')}), x AS (SELECT motif, round(pwm, 9) AS pwm, y FROM e JOIN labelled USING (seq_id)), {_RUN.format(extra='', source='x', part='')} SELECT motif, max(r1 / CAST(n1 AS DOUBLE) - r0 / CAST(n0 AS DOUBLE)) AS D, CAST(max(n1) AS BIGINT) AS n1, CAST(max(n0) AS BIGINT) AS n0 FROM r GROUP BY motif")
def _(spark, d):
    scores = E.extract_pwm(labelled_dna(spark, d), [motif("GATA")], id_cols=["seq_id", "y"]).withColumn("pwm", F.round("pwm", 9))
    return stats.ks_distance(scores, "pwm", "y", ["motif"], "greater")


@query("screen_pwm_clusters", f"WITH {energy_ctes(DOC_DNA, 'docs_dna', ['EBOX', 'GATA', 'TATA'])}, e AS ({lse('seq_id, motif')}), x AS (SELECT motif, cluster, round(pwm, 9) AS pwm, CASE WHEN lang = cluster THEN 1 ELSE 0 END AS y FROM e JOIN docs_dna USING (seq_id), (SELECT DISTINCT lang AS cluster FROM docs_dna)), {_RUN.format(extra='cluster, ', source='x', part=', cluster')}, o AS (SELECT motif, cluster, max(abs(r1 / CAST(n1 AS DOUBLE) - r0 / CAST(n0 AS DOUBLE))) AS D FROM r GROUP BY ALL) SELECT motif, cluster, D FROM o QUALIFY max(D) OVER (PARTITION BY motif) >= 0.1")
def _(spark, d):
    return R.screen_pwm_clusters(doc_dna(spark, d), "lang", motifs("EBOX", "GATA", "TATA"), min_D=0.1)


_ENRICH = f"WITH {energy_ctes(DOC_DNA, 'docs_dna', ['EBOX', 'GATA'])}, e AS ({lse('seq_id, motif')}), q AS (SELECT seq_id, source, motif, percent_rank() OVER (PARTITION BY motif ORDER BY round(pwm, 9)) AS q FROM e JOIN docs_dna USING (seq_id)), g AS (SELECT source AS \"group\", motif, CAST(sum(CASE WHEN q >= 0.9 THEN 1 ELSE 0 END) AS BIGINT) AS hits, count(*) AS n FROM q GROUP BY ALL), t AS (SELECT *, sum(hits) OVER (PARTITION BY motif) AS ah, sum(n) OVER (PARTITION BY motif) AS an FROM g) SELECT \"group\", motif, hits, n, %s AS enrichment FROM t"


def _ranked(spark, d):
    scores = E.extract_pwm(doc_dna(spark, d), motifs("EBOX", "GATA"), id_cols=["seq_id", "source"]).where("pwm is not null").withColumn("pwm", F.round("pwm", 9))
    return stats.percent_ranks(scores, "pwm", ["motif"])


@query("motif_enrichment_relative", _ENRICH % "(hits / CAST(n AS DOUBLE)) / nullif((ah - hits) / CAST(an - n AS DOUBLE), 0)")
def _(spark, d):
    return R.motif_enrichment(_ranked(spark, d), "source", 0.9)


@query("motif_enrichment_absolute", _ENRICH % "(hits / CAST(n AS DOUBLE)) / CAST(0.1 AS DOUBLE)")
def _(spark, d):
    return R.motif_enrichment(_ranked(spark, d), "source", 0.9, kind="absolute")


@query("pwm_quantiles", f"WITH {energy_ctes(ORDER_DNA, 'orders_dna', ['GATA'])}, e AS ({lse('seq_id')}) SELECT quantile_cont(pwm, 0.5) AS q50, quantile_cont(pwm, 0.9) AS q90, quantile_cont(pwm, 0.99) AS q99 FROM e")
def _(spark, d):
    q = stats.quantiles(E.compute_pwm(order_dna(spark, d), motif("GATA")), "pwm", [0.5, 0.9, 0.99], [])
    return q.select(*(F.col("quantiles")[i].alias(n) for i, n in enumerate(("q50", "q90", "q99"))))


@query("running_mean", f"WITH {ORDER_DNA} SELECT seq_id, avg(seq_id % 7) OVER (ORDER BY price, seq_id ROWS BETWEEN 49 PRECEDING AND 50 FOLLOWING) AS smooth FROM orders_dna")
def _(spark, d):
    df = order_dna(spark, d).withColumn("v", F.col("seq_id") % 7)
    return stats.running_mean(df, "price", "v", 100, buckets=4).select("seq_id", "smooth")


@query("mask_positions", f"WITH {counted_sql()}, p AS (SELECT motif, pos, (A + CAST(0.01 AS DOUBLE)) / (A + C + G + T + CAST(0.04 AS DOUBLE)) AS a, (C + CAST(0.01 AS DOUBLE)) / (A + C + G + T + CAST(0.04 AS DOUBLE)) AS c, (G + CAST(0.01 AS DOUBLE)) / (A + C + G + T + CAST(0.04 AS DOUBLE)) AS g, (T + CAST(0.01 AS DOUBLE)) / (A + C + G + T + CAST(0.04 AS DOUBLE)) AS t FROM m) SELECT motif, pos, 2 + a * log2(a) + c * log2(c) + g * log2(g) + t * log2(t) > 0.2 AS informative FROM p")
def _(spark, d):
    return P.bits_per_pos(counted_motifs(spark, d)).select("motif", "pos", (F.col("bits") > 0.2).alias("informative"))
