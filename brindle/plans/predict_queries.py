"""Queries over prediction tables, link prediction and placement."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import linkpred, placement, predict
from .inputs import lp_split, pred, register, sql, table
from .lineage import cut



def _soft(logit: str) -> str:
    return f"""soft as (select key, value, exp(logit - m) / sum(exp(logit - m)) over (partition by key) as probability
        from (select *, max(logit) over (partition by key) as m from (select *, {logit} as logit from pred) as x) as y)"""


def _round(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


@register("pred_upsert", sql("with w as (select event_type as key, 'click' as value, least(1, greatest(0, arg_max(value / 100, event_id))) as s from events group by event_type) select coalesce(w.key, p.key) as key, coalesce(w.value, p.value) as value, coalesce(s, score) as score from pred as p full join w on w.key = p.key and w.value = p.value"))
def pred_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = table(spark, sf_dir, "events").select(F.col("event_type").alias("key"), F.lit("click").alias("value"), (F.col("value") / 100).alias("score"), F.lit(None).cast(predict.WEIGHTS).alias("weights"), F.col("event_id").alias("seq"))
    return predict.upsert(pred(spark, sf_dir), log).select("key", "value", "score")


@register("pred_softmax", sql(f"with {_soft('score')} select key, value, round(probability, 6) as probability, row_number() over (partition by key order by probability desc, value) as rank from soft"))
def pred_softmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(predict.ranked(predict.softmax(pred(spark, sf_dir))), "probability")


@register("pred_ctx_softmax", sql(f"with {_soft('score + 0.4::double * score + 0.3::double * 0.5::double + bias')} select key, value, round(probability, 6) as probability from soft"))
def pred_ctx_softmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(predict.softmax(pred(spark, sf_dir), context=[[0.4, 0.3]]), "probability")


def _merge(mode: str) -> None:
    @register(f"pred_merge_{mode}", sql(f"with {_soft('score')} select value, round(least(1, {mode}(probability)), 6) as probability from soft group by value"))
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _round(predict.merged(predict.softmax(pred(spark, sf_dir)), mode), "probability")


def _inherit(mode: str) -> None:
    made = f"""with s as (select *, 1 / (1 + exp(-score)) as w from pred where value <> 'error')
        select key, 'calm' as value, round(least(24, greatest(-24, {mode}(score))), 6) as score, count(*) as used,
               round(sum(score * w) / sum(w), 6) as v0, 0.5::double as v1, round(sum(bias * w) / sum(w), 6) as bias, round(sum(w1 * w) / sum(w), 6) as d1 from s group by key"""

    @register(f"pred_inherit_{mode}", sql(made))
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        p = pred(spark, sf_dir)
        wanted = p.where("value <> 'error'").select("key", F.lit("calm").alias("target"), F.col("value").alias("source"))
        out = predict.inherit(p, wanted, mode)
        at = lambda d, i: F.col("weights")[d]["vector"][i]
        return _round(out.select("key", "value", "score", "used", at(0, 0).alias("v0"), at(0, 1).alias("v1"), F.col("weights")[0]["bias"].alias("bias"), at(1, 0).alias("d1")), "score", "v0", "v1", "bias", "d1")


for _mode in ("avg", "sum", "max"):
    _merge(_mode)
    _inherit(_mode)


@register(
    "pred_window_mean",
    "select label, i::int as position, round(avg(x), 6) as mean from (select label, unnest(embedding)::double as x, generate_subscripts(embedding, 1) - 1 as i from embeddings) as e group by all",
)
def pred_window_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select("label", F.col("embedding").cast("array<double>").alias("vector"))
    return _round(predict.window_mean(e, ["label"]), "mean")


@register(
    "pred_train_one_step",
    sql("select key, value, round(case when value = 'click' then score + .05 * (1 - 1 / (1 + exp(-score))) when value = 'error' then score - .05 / (1 + exp(-score)) else score end, 6) as score from pred"),
)
def pred_train_one_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(predict.train_one(pred(spark, sf_dir), target="click", negatives=["error"], rate=0.05).select("key", "value", "score"), "score")


@register("pred_train_sequence")
def pred_train_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as a training step of the type before it, in order."""
    from pyspark.sql import Window

    e = table(spark, sf_dir, "events")
    after = F.lead("event_type").over(Window.partitionBy("user_id").orderBy("event_id"))
    steps = e.select(F.col("event_type").alias("key"), F.col("event_id").alias("seq"), after.alias("target"), F.col("value")).where("target is not null")
    steps = steps.select("key", "seq", "target", F.array(F.lit("error")).alias("negatives"), F.lit(0.01).alias("rate"), F.array(F.array(F.col("value") / 500)).cast("array<array<double>>").alias("context"))
    return _round(predict.train(pred(spark, sf_dir), steps).select("key", "value", "score", F.size("weights").alias("depths")), "score")


_TERM = "(0.4::double * score + 0.3::double * 0.5::double + bias)"


@register("pred_ctx_bias", sql(f"select key, value, round(score + {_TERM} * 0.5::double, 6) as score from pred"))
def pred_ctx_bias(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(predict.adjust(pred(spark, sf_dir), [[0.4, 0.3]], strength=0.5).select("key", "value", "score"), "score")


@register("pred_ctx_scale", sql(f"select key, value, round(score * (1 + {_TERM}), 6) as score from pred"))
def pred_ctx_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(predict.adjust(pred(spark, sf_dir), [[0.4, 0.3]], mode="scale").select("key", "value", "score"), "score")


@register("pred_deepen")
def pred_deepen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The deepened context of every label: all its embeddings at full width, in order of vec_id, as rows."""
    e = table(spark, sf_dir, "embeddings").where("embedding is not null").groupBy("label").agg(F.array_sort(F.collect_list(F.struct("vec_id", F.col("embedding").cast("array<double>").alias("v")))).alias("r"))
    return e.select("label", predict.deepened(F.transform("r", lambda x: x["v"])).alias("context")).select("label", F.size("context").alias("rows"), F.transform("context", lambda r: F.transform(r, lambda x: F.round(x, 6))).alias("context"))


@register("pred_prune_weights", sql("select key, value, 2::int as kept from pred where w1 + bias >= 0.0001 union all select key, value, 1 from pred where w1 + bias < 0.0001"))
def pred_prune_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predict.pruned(pred(spark, sf_dir)).select("key", "value", F.size("weights").alias("kept"))


# Link prediction.


@register("lp_split", sql("select relation, count(*) as n from held group by relation"))
def lp_holdout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lp_split(spark, sf_dir)[1].groupBy("relation").agg(F.count("*").alias("n"))


@register("lp_priors", sql("select 'relation' as kind, relation, null::varchar as node, round(prior, 6) as p from rel_prior union all select 'source', relation, src, round(source_prior, 6) from src_prior union all select 'target', relation, dst, round(target_prior, 6) from tgt_prior"))
def lp_priors(spark: SparkSession, sf_dir: str) -> DataFrame:
    train = cut(lp_split(spark, sf_dir)[0])
    a = linkpred.relation_prior(train).select(F.lit("relation").alias("kind"), "relation", F.lit(None).cast("string").alias("node"), F.col("prior").alias("p"))
    b = linkpred.source_prior(train).select(F.lit("source").alias("kind"), "relation", F.col("src").alias("node"), F.col("source_prior").alias("p"))
    c = linkpred.target_prior(train).select(F.lit("target").alias("kind"), "relation", F.col("dst").alias("node"), F.col("target_prior").alias("p"))
    return _round(a.unionByName(b).unionByName(c), "p")


@register("lp_conditional", sql('select "left", "right", pair, presence, round(conditional, 6) as conditional from cond'))
def lp_conditional(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(linkpred.conditional(cut(lp_split(spark, sf_dir)[0])), "conditional")


@register("lp_category", sql("select relation, category, round(share, 6) as share from rel_cat"))
def lp_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(linkpred.relation_category(cut(lp_split(spark, sf_dir)[0])), "share")


@register("lp_candidates", sql("select * from cand"))
def lp_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, held = map(cut, lp_split(spark, sf_dir))
    return linkpred.candidates(held, train)


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, held = map(cut, lp_split(spark, sf_dir))
    rows = cut(linkpred.candidates(held, train))
    return cut(linkpred.implicit_scores(rows, train).select("relation", "src", "dst", "label", F.round("prob", 6).alias("prob"), F.round("implicit", 6).alias("implicit")))


_SCORED = "scored as (select relation, src, dst, label, round(prob, 6) as prob, round(implicit, 6) as implicit from impl)"


@register("lp_scores", sql(f"with {_SCORED} select * from scored"))
def lp_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probability and implicit scores of all candidates."""
    return _scored(spark, sf_dir)


_RERANK = "rr as (select *, row_number() over (order by implicit desc, label desc, relation, src, dst) <= 1000 as top from scored), final as (select relation, src, dst, label, prob, implicit, case when top then greatest(0, least(1, 0.4::double * implicit + 0.6::double * prob)) else implicit end as reranked from rr)"


@register("lp_rerank", sql(f"with {_SCORED}, {_RERANK} select relation, src, dst, label, round(reranked, 6) as reranked from final"))
def lp_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = linkpred.rerank(_scored(spark, sf_dir), 1000, 0.4, ties=("relation", "src", "dst"))
    return _round(out.select("relation", "src", "dst", "label", "reranked"), "reranked")


@register(
    "lp_metrics",
    sql(f"""with {_SCORED},
        up as (select label, row_number() over (order by implicit, label desc) as i from scored), down as (select label, row_number() over (order by implicit desc, label desc) as i from scored),
        seen as (select *, sum(label) over (order by i) as k from down)
        select (select round((sum(i) filter (label = 1) - count(*) filter (label = 1) * (count(*) filter (label = 1) + 1) / 2.0::double) / (count(*) filter (label = 1) * count(*) filter (label = 0))::double, 6) from up) as auc,
               (select round(avg(k / i::double), 6) from seen where label = 1) as ap, (select round(avg(label::double), 6) from down where i <= 100) as p_at_100,
               (select round(implicit, 6) from (select implicit, row_number() over (order by implicit) as i, count(*) over () as n from scored) as x where i = ceil(0.95::double * n)) as p95"""),
)
def lp_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _scored(spark, sf_dir)
    one = linkpred.auc(rows, "implicit").crossJoin(linkpred.average_precision(rows, "implicit")).crossJoin(linkpred.precision_at(rows, "implicit", 100).withColumnRenamed("precision_at_k", "p_at_100"))
    return _round(one.crossJoin(linkpred.percentile(rows, "implicit", 0.95).withColumnRenamed("percentile", "p95")), "auc", "ap", "p_at_100", "p95")


@register("fork_assign")
def fork_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nodes of a ring of three that each language and source of the documents is placed on."""
    ring = placement.Topology([placement.Member("a", capacity=4), placement.Member("b", capacity=2), placement.Member("c")], replication=2)
    prefixes = table(spark, sf_dir, "documents").select(F.concat_ws(":", F.lit("ctx"), "lang", "source").alias("prefix")).distinct()
    return placement.assign_all(prefixes, ring)


