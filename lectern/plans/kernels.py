"""Numeric kernels over the columns of whole tables."""

from pyspark.sql import functions as F

from lectern.operators import kernels, retrieval
from lectern.plans.registry import registry
from lectern.sources.tables import table

QUERIES, ORACLE, query = registry()
POINTS = "p as (select vec_id as id, embedding[1]::double as x, embedding[2]::double as y, (label % 2)::int as label from embeddings)"


def points(spark, sf_dir):
    e = F.col("embedding")
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), e[0].cast("double").alias("x"), e[1].cast("double").alias("y"), (F.col("label") % 2).alias("label"))


@query(f"with {POINTS}, n as (select label from p order by round(sqrt(power(x - 0.05, 2) + power(y + 0.02, 2)), 6), id limit 7) select sum(label)::bigint as votes, case when sum(label) > 3.5 then 1 else 0 end as label from n")
def knn_vote(spark, sf_dir):
    return kernels.knn_vote(points(spark, sf_dir), [0.05, -0.02], 7)


START = [(-0.1, 0.0), (0.1, 0.0), (0.0, 0.1)]


def _lloyd(steps: int) -> str:
    parts = [POINTS, f"c0 as (select * from (values {', '.join(f'({k}, {x}::double, {y}::double)' for k, (x, y) in enumerate(START))}) v(c, x, y))"]
    for s in range(steps):
        parts.append(f"a{s} as (select p.id, p.x, p.y, c.c from p, c{s} c qualify row_number() over (partition by p.id order by round(power(p.x - c.x, 2) + power(p.y - c.y, 2), 9), c.c) = 1)")
        parts.append(f"c{s + 1} as (select c{s}.c, coalesce(round(avg(a.x), 6), any_value(c{s}.x)) as x, coalesce(round(avg(a.y), 6), any_value(c{s}.y)) as y from c{s} left join a{s} a on a.c = c{s}.c group by c{s}.c)")
    return f"with {', '.join(parts)} select c as cluster, x, y from c{steps}"


@query(_lloyd(3))
def kmeans_step(spark, sf_dir):
    found = kernels.kmeans(points(spark, sf_dir), START, 3)
    rows = F.array(*(F.struct(F.lit(k).alias("cluster"), F.lit(x).alias("x"), F.lit(y).alias("y")) for k, (x, y) in enumerate(found)))
    return spark.range(1).select(F.explode(rows).alias("r")).select("r.*")


@query("""with c as (select count(*) filter (where toxic = 1 and quality = 0) as tp, count(*) filter (where toxic = 0 and quality = 0) as fp, count(*) filter (where toxic = 1 and quality = 1) as fn, count(*) filter (where toxic = 0 and quality = 1) as tn from labels),
d as (select *, case when tp + fp = 0 then 0 else tp / (tp + fp) end as p, case when tp + fn = 0 then 0 else tp / (tp + fn) end as r from c)
select tp, fp, fn, tn, round(p, 6) as precision, round(r, 6) as recall, case when p + r = 0 then 0 else round(2 * p * r / (p + r), 6) end as f1 from d""")
def confusion_matrix(spark, sf_dir):
    return kernels.confusion(table(spark, sf_dir, "labels").select(F.col("toxic").alias("truth"), (1 - F.col("quality")).alias("guess")))


@query("select a.vec_id as a, b.vec_id as b, round(list_cosine_similarity(a.embedding::double[], b.embedding::double[]), 6) as cosine from embeddings a join embeddings b on b.vec_id = a.vec_id + 1")
def cosine_pairs(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    left, right = e.select(F.col("vec_id").alias("a"), F.col("embedding").alias("x")), e.select(F.col("vec_id").alias("b"), F.col("embedding").alias("y"))
    return left.join(right, F.col("b") == F.col("a") + 1).select("a", "b", F.round(retrieval.cosine(F.col("x"), F.col("y")), 6).alias("cosine"))


@query("select vec_id, round(exp(-0.5 * power(embedding[1]::double / 0.12::double, 2)) / (0.12::double * sqrt(2 * pi())), 6) as density, abs(embedding[1]::double) <= 0.12::double as in_band from embeddings")
def normal_pdf(spark, sf_dir):
    """The density of the first number of each embedding and whether it is within a deviation of the middle."""
    x = F.col("embedding")[0].cast("double")
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(kernels.normal_pdf(x, 0.0, 0.12), 6).alias("density"), (F.abs(x) <= 0.12).alias("in_band"))


@query("""with p as (select vec_id, i - 1 as i, embedding[i]::double as v from embeddings, range(1, 65) r(i)), c as (select *, i % 8 as x, i // 8 as y from p),
s as (select p.vec_id, p.i, count(*) as n, sum(q.v * case when q.i = p.i then 8 else -1 end) as s from c p join c q on q.vec_id = p.vec_id and abs(q.x - p.x) <= 1 and abs(q.y - p.y) <= 1 group by p.vec_id, p.i)
select vec_id, list(round(case when n = 9 then greatest(0, least(1, s)) else v end, 6) order by i) as image from c join s using (vec_id, i) group by vec_id""")
def convolve3x3(spark, sf_dir):
    """Each embedding as an image of 8 by 8, its edges."""
    return table(spark, sf_dir, "embeddings").select("vec_id", kernels.convolve(F.col("embedding"), 8, "edge").alias("image"))


@query("""with g as (select l_orderkey, l_linenumber, l_linenumber % 3 as coef, l_discount * 20 as lam, l_quantity / 50 as base from lineitem),
v as (select *, base / (1 + 4 * lam) as ridge, greatest(0, base - lam * 1.1::double * (1 + coef * 0.4::double)) as lasso from g)
select l_orderkey, l_linenumber, round(ridge, 6) as ridge, round(lasso, 6) as lasso, round(0.5::double * lasso + 0.5::double * ridge, 6) as elastic from v""")
def coef_paths(spark, sf_dir):
    """The quantity of each line item as a coefficient, shrunk by its discount in three ways."""
    shrunk = kernels.coefficients(F.col("l_linenumber") % 3, F.col("l_quantity") / 50, F.col("l_discount") * 20)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", shrunk.alias("c")).select("l_orderkey", "l_linenumber", "c.*")


@query("""with g as (select source, doc_id, n_chars / 5000 as x from documents), b as (select source, doc_id, round(greatest(0.04::double, 1 / (0.8::double + x * 0.9::double)) + greatest(0.02::double, power(x * 0.8::double, 1.6::double) * 0.5::double) + 0.05::double, 6) as total from g)
select source, min_by(doc_id, struct_pack(t := total, d := doc_id)) as best, min(total) as total from b group by source""")
def bias_variance_argmin(spark, sf_dir):
    """The document of each source whose length, in 5,000 characters, has the least error of bias and variance."""
    curve = table(spark, sf_dir, "documents").select("source", "doc_id", kernels.bias_variance(F.col("n_chars") / 5000, 1.0)["total"].alias("total"))
    return curve.groupBy("source").agg(F.min_by("doc_id", F.struct("total", "doc_id")).alias("best"), F.min("total").alias("total"))


@query("""with m as (select ((year(o_orderdate) - 1992) * 12 + month(o_orderdate) - 1)::int as i, round(sum(o_totalprice), 2) as price from orders group by 1)
select i, price, round(0.5::double * (i / 48) + 0.6::double * sin(i / 6 * pi()) + case when i < 48 then (sin(i * 12.9898::double) * 43758.5453::double - trunc(sin(i * 12.9898::double) * 43758.5453::double) - 0.5::double) * 0.25::double else 0 end + 1, 6) as v from m""")
def trend_season(spark, sf_dir):
    """What was ordered in each month beside a trend with a season of a year."""
    i = ((F.year("o_orderdate") - 1992) * 12 + F.month("o_orderdate") - 1).cast("int")
    months = table(spark, sf_dir, "orders").groupBy(i.alias("i")).agg(F.round(F.sum("o_totalprice"), 2).alias("price"))
    return months.select("i", "price", kernels.trend_season(F.col("i"), 0.5, 0.6).alias("v"))


@query("with m as (select min(n_chars) as a, max(n_chars) as b from documents) select doc_id, round((n_chars - a) / (b - a), 6) as scaled from documents, m")
def axis_scaling(spark, sf_dir):
    return kernels.scaled(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "n_chars").select("doc_id", "scaled")


@query("with c as (select source, count(*) as n from documents group by source) select source, round(0.12::double + 0.55::double * n / (select max(n) from c), 6) as heat from c")
def heat_intensity(spark, sf_dir):
    return kernels.heat(table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("n")), "n").select("source", "heat")


@query("""with recursive r as (select vec_id, 0 as t, embedding[1]::double as w, 0::double as m, 0::double as v, (0.05::double + 0.01::double * (label % 5)) as rate from embeddings union all
select vec_id, t + 1, w - rate * ((0.9::double * m + (1 - 0.9::double) * g) / (1 - power(0.9::double, t + 1))) / (sqrt((0.999::double * v + (1 - 0.999::double) * g * g) / (1 - power(0.999::double, t + 1))) + 1e-8), 0.9::double * m + (1 - 0.9::double) * g, 0.999::double * v + (1 - 0.999::double) * g * g, rate
from (select *, 2 * (w - 1.4::double) + 0.75::double * cos(5 * w) as g from r) where t < 30) select vec_id, t, round(w, 6) as w from r where t > 0""")
def optimiser_trace(spark, sf_dir):
    """Thirty steps of Adam for each embedding: from its first number, at a rate by its label."""
    path = kernels.optimiser(F.col("embedding")[0], 0.05 + 0.01 * (F.col("label") % 5), "adam", 30)
    steps = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(path).alias("t", "w"))
    return steps.select("vec_id", (F.col("t") + 1).alias("t"), F.round("w", 6).alias("w"))
