"""Scalar functions on texts and vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scantling.functions import prompts, vectors
from scantling.functions.order import portable_key
from scantling.plans.encode import hashed, surrogate_difference, token_rows
from scantling.plans.encode import vectors as encoded
from scantling.queries import query
from scantling.queries.sources import DIFF
from scantling.session import table
from scantling.sources import store, texts


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


@query("fn_1", "select sample_id, coalesce(question_id, category, 'none') as first from mask")
def fn_1(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "mask")
    return df.select("sample_id", texts.first_of(df, ("absent", "question_id", "category"), "none").alias("first"))


@query("fn_2", "select sample_id, category as first from mask where category is not null")
def fn_2(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "mask").where("category is not null")
    return df.select("sample_id", texts.first_of(df, ("absent", "category"), required=True).alias("first"))


@query(
    "fn_3",
    """with v as (select sample_id, label, category, question_id from mask)
select sample_id, case when label = 1 then 1 else 0 end as a, case when label = 2 then 1 else 0 end as b, case when category = 'rumour' then 1 else 0 end as c from v""",
)
def fn_3(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "mask")
    words = F.when(F.col("category") == "rumour", " Dishonest").otherwise("HAM ")
    return df.select("sample_id", F.when(F.col("label") == 1, F.lit("Yes")).otherwise(F.lit("no")).alias("w"), "label", words.alias("c")).select(
        "sample_id", texts.binary_label(F.col("w")).alias("a"), F.when(F.col("label") == 2, 1).otherwise(0).alias("b"), texts.binary_label(F.col("c")).alias("c")
    )


@query("fn_4", "select sample_id, coalesce(try_cast(question_id as int), 1) as label from mask")
def fn_4(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "mask").select("sample_id", F.coalesce(F.col("question_id").try_cast("int"), F.lit(1)).alias("label"))


@query("fn_5", "select sample_id, coalesce(nullif(pressure_prompt, ''), proposition) as text from mask")
def fn_5(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "mask").select("sample_id", F.coalesce(F.nullif("pressure_prompt", F.lit("")), "proposition").alias("text"))


@query("fn_6", f"select sample_id, {quoted(prompts.SPAM_QUESTION)} || chr(10) || chr(10) || text || chr(10) || chr(10) || 'Answer:' as prompt from sms")
def fn_6(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "sms").select("sample_id", prompts.filter_prompt("sms", F.col("text")).alias("prompt"))


_SECTIONS = ", ".join(f"case when {c} <> '' then {quoted(label)} || {c} end" for c, label in prompts.MASK_SECTIONS)


@query("fn_7", f"select sample_id, concat_ws(chr(10) || chr(10), {quoted(prompts.MASK_QUESTION)}, {_SECTIONS}, 'Answer:') as prompt from mask")
def fn_7(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "mask").select("*", prompts.filter_prompt("mask", F.col("text")).alias("prompt")).select("sample_id", "prompt")


@query("fn_9", f"select sample_id, {quoted(prompts.PREFIX['spam'])} as prefix from sms union all select sample_id, {quoted(prompts.PREFIX['honesty'])} from mask")
def fn_9(spark: SparkSession, d: str) -> DataFrame:
    a, b = (table(spark, d, t).select("sample_id", prompts.prompted(t, F.lit("")).alias("prefix")) for t in ("sms", "mask"))
    return a.unionByName(b)


def _followup_sql(kind: str) -> str:
    return quoted(prompts.FOLLOWUP[kind].strip())


@query("fn_10", f"select sample_id, {_followup_sql('spam')} as question from sms union all select sample_id, {_followup_sql('honesty')} from mask")
def fn_10(spark: SparkSession, d: str) -> DataFrame:
    a, b = (table(spark, d, t).select("sample_id", F.ltrim(F.regexp_replace(prompts.followed_up(t, F.lit("")), r"^\n+", "")).alias("question")) for t in ("sms", "mask"))
    return a.unionByName(b)


@query("fn_11", f"select sample_id, {quoted(prompts.PREFIX['spam'])} || text as prompted, text || chr(10) || chr(10) || {_followup_sql('spam')} as followed from enron")
def fn_11(spark: SparkSession, d: str) -> DataFrame:
    text = F.col("text")
    return table(spark, d, "enron").select("sample_id", prompts.in_mode("enron", "prompted", text).alias("prompted"), prompts.in_mode("enron", "followup", text).alias("followed"))


@query("fn_12", "select distinct run_id, concat_ws('__', replace(model, '/', '_'), dataset, scorer, 'layer' || layer, 'k' || k, 'seed' || seed, balance_mode) as built from runs")
def fn_12(spark: SparkSession, d: str) -> DataFrame:
    built = store.run_id(*(F.col(c) for c in ("model", "dataset", "scorer", "layer", "k", "seed", "balance_mode")))
    return table(spark, d, "runs").select("run_id", built.alias("built")).distinct()


@query("fn_14", f"select sample_id, {DIFF} as logit_diff from sms where text is not null")
def fn_14(spark: SparkSession, d: str) -> DataFrame:
    return surrogate_difference(table(spark, d, "sms").where("text is not null")).select("sample_id", "logit_diff")


@query("fn_15", r"select sample_id, list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')[1:512] as tokens from sms where text is not null")
def fn_15(spark: SparkSession, d: str) -> DataFrame:
    return token_rows(table(spark, d, "sms").where("text is not null")).select("sample_id", "tokens")


WIDTH = 32


def _encoded_sql(text: str, start: str = "0") -> str:
    """Vectors of the built-in encoder at layers 0 and 1: mean of the values of the tokens from a start on."""
    return f"""with parts as (select sample_id, label, list_filter(regexp_split_to_array({text}, '\\s+'), lambda w: w <> '')[1:512] as t from sms),
kept as (select sample_id, label, t[greatest(least({start}, len(t) - 1), 0) + 1:] as t from parts),
words as (select sample_id, unnest(t) as w from kept), hashes as (select distinct w, layer, k, md5(w || '|' || layer || '|' || k) as h from words, range(2) l(layer), range({WIDTH // 8}) x(k)),
values_of as (select w, layer, k * 8 + j as i, (cast('0x' || substr(h, j * 4 + 1, 4) as bigint) % 2048 - 1024) / 1024.0::double as v from hashes, range(8) y(j)),
means as (select sample_id, layer, i, (sum(v) / count(*))::float as v from words join values_of using (w) group by sample_id, layer, i),
rows_of as (select sample_id, layer, list(v order by i) as x from means group by sample_id, layer)
select sample_id, label, l.layer::int as layer, coalesce(x, list_transform(range({WIDTH}), lambda i: 0::float)) as x from kept cross join range(2) l(layer) left join rows_of using (sample_id, layer)"""


@query("fn_16", _encoded_sql(f"{quoted(prompts.PREFIX['spam'])} || coalesce(text, '')").replace("|| coalesce(text, '')", "|| text"))
def fn_16(spark: SparkSession, d: str) -> DataFrame:
    """Vectors of the messages at two layers, by the built-in encoder."""
    return encoded(table(spark, d, "sms"), "sms", "prompted", [0, 1], hashed(WIDTH))


@query("fn_19", _encoded_sql("text", "sample_id % 7"))
def fn_19(spark: SparkSession, d: str) -> DataFrame:
    """Vectors pooled from a token on, another for each message."""
    return encoded(table(spark, d, "sms"), "sms", "base", [0, 1], hashed(WIDTH), F.col("sample_id") % 7)


@query("fn_18", "select sample_id, list_transform(range(8), lambda i: case when i >= least(greatest(sample_id % 11 - 1, 0), 1 + sample_id % 8 - 1) and i < 1 + sample_id % 8 then 1 else 0 end) as mask from sms")
def fn_18(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("sample_id").cast("int")
    return table(spark, d, "sms").select("sample_id", vectors.pooling_mask(F.lit(8), 1 + n % 8, n % 11 - 1).alias("mask"))


@query(
    "agg_9",
    """select vec_id, list_transform(range(1, 5), lambda i: round((x[i] * m1 + x[i + 4] * m2 + x[i + 8] * m3) / greatest(m1 + m2 + m3, 1), 6) + 0.0) as pooled
from (select vec_id, list_transform(x, lambda v: v::double) as x, vec_id % 2 as m1, (vec_id // 2) % 2 as m2, (vec_id // 4) % 2 as m3 from activations where x is not null and len(list_filter(x, lambda v: isnan(v))) = 0)""",
)
def agg_9(spark: SparkSession, d: str) -> DataFrame:
    """Masked mean over three tokens of four values."""
    rows = table(spark, d, "activations").where("x is not null").where(~vectors.has_nan(F.col("x")))
    n = F.col("vec_id")
    mask = F.array(*((F.floor(n / k) % 2).cast("int") for k in (1, 2, 4)))
    parts = F.array(*(F.slice("x", 1 + 4 * k, 4) for k in range(3)))
    return rows.select("vec_id", F.transform(vectors.masked_mean(parts, mask), lambda v: F.round(v, 6) + F.lit(0.0)).alias("pooled"))


_PAIR = "from activations a join activations b on b.vec_id = a.vec_id + 1 where a.x is not null and b.x is not null and len(list_filter(a.x, lambda v: isnan(v))) = 0 and len(list_filter(b.x, lambda v: isnan(v))) = 0"
_DOT = "list_sum(list_transform(range(1, len({0}) + 1), lambda i: {0}[i]::double * {1}[i]::double))"


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "activations").where("x is not null").where(~vectors.has_nan(F.col("x"))).select("vec_id", F.col("x").alias("a"))
    return a.join(a.select((F.col("vec_id") - 1).alias("vec_id"), F.col("a").alias("b")), "vec_id")


@query("fn_20", f"select a.vec_id, round({_DOT.format('a.x', 'b.x')}, 6) as dot {_PAIR}")
def fn_20(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(spark, d).select("vec_id", F.round(vectors.dot(F.col("a"), F.col("b")), 6).alias("dot"))


@query("fn_21", f"select a.vec_id, round(sqrt({_DOT.format('a.x', 'a.x')}), 6) as norm {_PAIR}")
def fn_21(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(spark, d).select("vec_id", F.round(vectors.norm(F.col("a")), 6).alias("norm"))


@query("fn_22", f"select a.vec_id, round(case when sqrt({_DOT.format('a.x', 'a.x')}) * sqrt({_DOT.format('b.x', 'b.x')}) > 0 then {_DOT.format('a.x', 'b.x')} / (sqrt({_DOT.format('a.x', 'a.x')}) * sqrt({_DOT.format('b.x', 'b.x')})) else 0 end, 6) as cosine {_PAIR}")
def fn_22(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(spark, d).select("vec_id", F.round(vectors.cosine(F.col("a"), F.col("b")), 6).alias("cosine"))


@query("fn_24", "select vec_id, round(list_max(list_transform(x, lambda v: abs(v))), 6) as most, len(list_filter(x, lambda v: v > 0)) as positive from activations where x is not null and len(list_filter(x, lambda v: isnan(v))) = 0")
def fn_24(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "activations").where("x is not null").where(~vectors.has_nan(F.col("x")))
    return rows.select("vec_id", F.round(F.array_max(F.transform("x", F.abs)), 6).alias("most"), F.size(F.filter("x", lambda v: v > 0)).cast("bigint").alias("positive"))


@query("fn_25", "select run_id, k, layer from runs")
def fn_25(spark: SparkSession, d: str) -> DataFrame:
    """Rows through JSON and back."""
    packed = table(spark, d, "runs").select(F.to_json(F.struct("run_id", "k", "layer")).alias("j"))
    return packed.select(F.from_json("j", "run_id string, k int, layer int").alias("r")).select("r.*")


@query("order_key", "select sample_id, md5('7|' || sample_id) as ord from enron")
def order_key(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "enron").select("sample_id", portable_key(7, F.col("sample_id")).alias("ord"))
