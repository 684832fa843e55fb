"""Queries over evaluation items, scores and training curves.

Model outputs aren't part of the tables; scores are numbers by hash of the keys.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import sampling
from ..functions.text import strip
from ..functions.tokens import stub_ids
from ..operators import compare, encode, evaluation, stats
from ..operators.prefix import quantiles, ranked
from ..session import new_path
from ..sources import items as item_sources
from ..sources import sinks
from .common import TOKENIZED, WS, digest, score, sql_digest, sql_score, table, tokenized

Q: dict = {}
SQL: dict = {}


def query(name: str, sql: str | None = None):
    def add(f):
        Q[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


_PROBLEM = """case when trim(coalesce(ctx, '')) = '' then 'empty ctx' when endings is null or len(endings) < 2 then 'too few endings' when len(list_filter(endings, lambda e: trim(coalesce(e, '')) = '')) > 0 then 'empty ending'
 when len(list_filter(endings, lambda e: not starts_with(e, ' '))) > 0 then 'ending without space' when label is null or label < 0 or label >= len(endings) then 'label out of range' end"""


@query("s08_item_rules", f"select coalesce({_PROBLEM}, 'valid') as problem, count(*) as n from (select item_id, case item_id % 5 when 1 then [endings[1]] when 2 then list_transform(endings, lambda e: trim(e)) else endings end as endings, case when item_id % 5 = 3 then 9 else label end as label, ctx from eval_items) group by 1")
def s08(spark, sf):
    items = table(spark, sf, "eval_items")
    endings = F.when(F.col("item_id") % 5 == 1, F.slice("endings", 1, 1)).when(F.col("item_id") % 5 == 2, F.transform("endings", lambda e: F.trim(e))).otherwise(F.col("endings"))
    label = F.when(F.col("item_id") % 5 == 3, 9).otherwise(F.col("label"))
    return items.select(F.coalesce(item_sources.item_problem(F.col("ctx"), endings, label), F.lit("valid")).alias("problem")).groupBy("problem").agg(F.count("*").alias("n"))


@query("s07_items", "select item_id, label, len(endings) as n_endings, coalesce(activity_label, 'unknown') as category from eval_items")
def s07(spark, sf):
    return item_sources.checked_items(table(spark, sf, "eval_items")).select("item_id", "label", F.size("endings").cast("long").alias("n_endings"), "category")


@query("s08_parsed_items", "select item_id as line_no, coalesce(ind::varchar, 'line_' || item_id) as id, coalesce(activity_label, 'unknown') as category, label::int as label, md5(ctx) as ctx from eval_items")
def s08_parsed(spark, sf):
    """Items from their JSON lines, every third line with a mark of byte order before it, blank lines between, defaults for category and id."""
    items = table(spark, sf, "eval_items")
    line = F.to_json(F.struct("ctx", "endings", F.col("label").cast("string").alias("label"), "activity_label", "ind"))
    marked = F.when(F.col("item_id") % 3 == 0, F.concat(F.lit("\ufeff"), line)).otherwise(line)
    lines = items.select(F.col("item_id").alias("line_no"), marked.alias("line")).unionByName(items.select(F.col("item_id").alias("line_no"), F.lit("  ").alias("line")))
    return item_sources.checked_items(item_sources.parsed_items(lines)).select("line_no", "id", "category", "label", F.md5("ctx").alias("ctx"))


@query("s09_scorers", "select name, case when name like '%/mc\\_%' escape '\\' then 'multiple_choice' when name like '%/gen\\_%' escape '\\' then 'generative' end as scorer from (select distinct 'tasks/' || case when item_id % 3 = 0 then 'mc_' when item_id % 3 = 1 then 'gen_' else 'x_' end || benchmark || '.jsonl' as name from eval_items)")
def s09(spark, sf):
    prefix = F.when(F.col("item_id") % 3 == 0, "mc_").when(F.col("item_id") % 3 == 1, "gen_").otherwise("x_")
    names = table(spark, sf, "eval_items").select(F.concat(F.lit("tasks/"), prefix, "benchmark", F.lit(".jsonl")).alias("name")).distinct()
    return names.select("name", item_sources.scorer(F.col("name")).alias("scorer"))


def _choices(spark, sf) -> DataFrame:
    return table(spark, sf, "eval_items").select("item_id", "ctx", "label", "benchmark", "activity_label", F.posexplode("endings").alias("choice", "ending"))


_CHOICES = "(select item_id, ctx, label, benchmark, activity_label, unnest(endings) as ending, generate_subscripts(endings, 1) - 1 as choice from eval_items)"
_ID = lambda t: f"list_transform(string_split({t}, ''), lambda c: unicode(c) % 500 + 3)"


@query("t11_keep_last", f"with r as (select item_id, choice, list_concat({_ID('ctx')}, {_ID('ending')}) as t from {_CHOICES}) select item_id, choice::int as choice, {sql_digest('t[greatest(1, len(t) - 255):]')} as tokens from r")
def t11(spark, sf):
    return _choices(spark, sf).select("item_id", "choice", digest(encode.keep_last(stub_ids("ctx"), stub_ids("ending"), 256)).alias("tokens"))


@query("t11_trim_context", f"with r as (select item_id, choice, {_ID('ctx')} as c, {_ID('ending')} as e from {_CHOICES}) select item_id, choice::int as choice, {sql_digest('c[greatest(1, len(c) - (300 - len(e)) + 1):]')} as tokens from r")
def t11_trim(spark, sf):
    return _choices(spark, sf).select("item_id", "choice", digest(encode.trim_context(stub_ids("ctx"), stub_ids("ending"), 300)).alias("tokens"))


@query("k16_length_sorted", f"""with l as (select item_id, max(length(ctx) + length(ending)) as m from {_CHOICES} group by 1) select item_id, ((row_number() over (order by m, item_id) - 1) // 16)::bigint as batch_id from l""")
def k16(spark, sf):
    """Items by their longest request, ranked by range partitions."""
    longest = _choices(spark, sf).groupBy("item_id").agg(F.max(F.length("ctx") + F.length("ending")).alias("m"))
    return ranked(longest, "m", "item_id", out="place").select("item_id", F.floor((F.col("place") - 1) / 16).alias("batch_id"))


def _token_scores(spark, sf) -> DataFrame:
    """item_id, choice, token_idx, logprob for every character of every ending."""
    c = _choices(spark, sf).select("item_id", "choice", F.explode(F.sequence(F.lit(0), F.length("ending") - 1)).alias("token_idx"))
    return c.withColumn("logprob", -score("item_id", "choice", "token_idx"))


_SCORES = f"(select item_id, choice, token_idx, -{sql_score('item_id', 'choice', 'token_idx')} as logprob from (select item_id, choice, unnest(range(length(ending))) as token_idx from {_CHOICES}))"
_SUMS = f"(select item_id, choice, sum(logprob) as s, sum(logprob) / count(*) as m from {_SCORES} group by 1, 2)"
_PICKED = f"(select item_id, arg_max(choice, (s, -choice)) as raw, arg_max(choice, (m, -choice)) as norm from {_SUMS} group by 1)"


@query("a16_multiple_choice", f"select item_id, raw::int as choice from (select item_id, choice as raw from (select *, row_number() over (partition by item_id order by s desc, choice) as r from {_SUMS}) where r = 1)")
def a16(spark, sf):
    return evaluation.choose(_token_scores(spark, sf), False)


Q["l05_first_best"], SQL["l05_first_best"] = Q["a16_multiple_choice"], SQL["a16_multiple_choice"]


_BEST = lambda v: f"(select item_id, choice from (select *, row_number() over (partition by item_id order by {v} desc, choice) as r from {_SUMS}) where r = 1)"


def _accuracy_sql(by: str) -> str:
    return f"""with j as (select coalesce({by}, 'unknown') as {by}, (r.choice = label)::int as raw, (n.choice = label)::int as norm from eval_items i join {_BEST('s')} r on r.item_id = i.item_id join {_BEST('m')} n on n.item_id = i.item_id)
 select {by}, count(*) as n, round(avg(raw), 9) as acc, round(avg(norm), 9) as acc_norm from j group by rollup({by})"""


@query("a17_accuracy_by_benchmark", _accuracy_sql("benchmark"))
def a17(spark, sf):
    out = evaluation.accuracy(_token_scores(spark, sf), table(spark, sf, "eval_items").select("item_id", "label", "benchmark"), "benchmark")
    return out.withColumn("acc", F.round("acc", 9)).withColumn("acc_norm", F.round("acc_norm", 9))


@query("a18_accuracy_by_category", _accuracy_sql("activity_label"))
def a18(spark, sf):
    out = evaluation.accuracy(_token_scores(spark, sf), table(spark, sf, "eval_items").select("item_id", "label", "activity_label"), "activity_label")
    return out.withColumn("acc", F.round("acc", 9)).withColumn("acc_norm", F.round("acc_norm", 9))


_TIMED = f"(select coalesce(activity_label, 'unknown') as activity_label, {sql_score('item_id', 'label')} + 0.5 as seconds from eval_items)"


@query("a18_throughput", f"select activity_label, count(*) as n, round(count(*) / sum(seconds), 6) as per_second from {_TIMED} group by rollup(activity_label)")
def a18_throughput(spark, sf):
    """Items a second by category and in total; the seconds are numbers by hash."""
    timed = table(spark, sf, "eval_items").select("activity_label", (score("item_id", "label") + 0.5).alias("seconds"))
    return evaluation.throughput(timed, "activity_label", "seconds").withColumn("per_second", F.round("per_second", 6))


@query("l07_predictions", f"select cast(item_id as varchar) as id, choice::int as choice from {_BEST('s')} order by 1")
def l07(spark, sf):
    return evaluation.choose(_token_scores(spark, sf), False).select(F.col("item_id").cast("string").alias("id"), "choice").orderBy("id")


_GENERATED = "(select item_id, endings[label + 1] as reference, case item_id % 3 when 0 then ctx || upper(endings[label + 1]) when 1 then trim(endings[label + 1]) else ctx end as generated, case when item_id % 2 = 0 then 'exact' else 'contains' end as mode from eval_items)"


@query("a19_generative", f"select mode, count(*) as n, sum(case mode when 'exact' then (trim(generated) = trim(reference))::int else contains(lower(generated), lower(reference))::int end)::bigint as correct from {_GENERATED} group by 1")
def a19(spark, sf):
    ref = F.element_at("endings", F.col("label") + 1)
    text = F.when(F.col("item_id") % 3 == 0, F.concat("ctx", F.upper(ref))).when(F.col("item_id") % 3 == 1, F.trim(ref)).otherwise(F.col("ctx"))
    g = table(spark, sf, "eval_items").select(ref.alias("reference"), text.alias("generated"), F.when(F.col("item_id") % 2 == 0, "exact").otherwise("contains").alias("mode"))
    return g.groupBy("mode").agg(F.count("*").alias("n"), F.count_if(evaluation.matches(F.col("generated"), F.col("reference"), F.col("mode"))).alias("correct"))


@query("a19_tool", "select case when item_id % 3 = 0 then 'tool' when item_id % 3 = 1 then 'contains' else 'exact' end as mode, count(*) as n, count(*) filter (case item_id % 3 when 0 then item_id % 12 = 0 when 1 then true else item_id % 2 = 0 end) as correct from eval_items group by 1")
def a19_tool(spark, sf):
    """The three modes side by side: calls of the expected tool, of another one, without a name and never closed; answers in other case; answers with blanks or more text around."""
    items = table(spark, sf, "eval_items")
    kind, text = F.col("item_id") % 12, F.col("benchmark")
    name = F.when(kind == 3, F.concat(text, F.lit("x"))).otherwise(text)
    payload = F.when(kind == 6, F.lit('{"tool":1}')).otherwise(F.concat(F.lit('{"name":"'), name, F.lit('"}')))
    ids = F.concat(F.array(F.lit(11)), stub_ids(payload), F.when(kind == 9, F.array().cast("array<int>")).otherwise(F.array(F.lit(13))))
    said = F.when(F.col("item_id") % 3 == 1, F.concat(F.lit("x "), F.upper("benchmark"))).when(F.col("item_id") % 2 == 0, F.concat(F.lit("  "), text, F.lit(" "))).otherwise(F.concat(text, F.lit(" and more")))
    mode = F.when(F.col("item_id") % 3 == 0, "tool").when(F.col("item_id") % 3 == 1, "contains").otherwise("exact")
    decode = lambda body: F.array_join(F.transform(body, lambda i: F.char(i - 3)), "")
    hit = evaluation.matches(said, text, mode, ids, text, decode)
    return items.select(mode.alias("mode"), hit.alias("hit")).groupBy("mode").agg(F.count("*").alias("n"), F.count_if("hit").alias("correct"))


@query("l06_first_shown", f"select mode, item_id from (select mode, item_id, row_number() over (partition by mode order by item_id) as r from {_GENERATED}) where r <= 3")
def l06(spark, sf):
    g = table(spark, sf, "eval_items").select("item_id", F.when(F.col("item_id") % 2 == 0, "exact").otherwise("contains").alias("mode"))
    return g.withColumn("r", F.row_number().over(Window.partitionBy("mode").orderBy("item_id"))).where("r <= 3").select("mode", "item_id")


@query("a20_tool_calls", """select item_id, (item_id % 4 in (0, 1)) as has_call, (item_id % 4 = 0) as valid from eval_items""")
def a20(spark, sf):
    """Calls around each item's benchmark name: a good one, one without a name, one never closed, one closed before it opens."""
    payload = F.when(F.col("item_id") % 4 == 0, F.concat(F.lit('{"name":"'), "benchmark", F.lit('"}'))).otherwise(F.lit('{"tool":1}'))
    ids = stub_ids(payload)
    call = F.when(F.col("item_id") % 4 <= 1, F.concat(F.array(F.lit(11)), ids, F.array(F.lit(13)))).when(F.col("item_id") % 4 == 2, F.concat(F.array(F.lit(11)), ids)).otherwise(F.concat(F.array(F.lit(13)), F.array(F.lit(11))))
    # characters of ids 3 to 502 are told apart only below 500, which holds for these payloads
    rows = table(spark, sf, "eval_items").select("item_id", "benchmark", call.alias("ids")).withColumn("body", evaluation.tool_call_body(F.filter("ids", lambda i: F.lit(True))))
    text = F.array_join(F.transform("body", lambda i: F.char(i - 3)), "")
    return rows.select("item_id", F.col("body").isNotNull().alias("has_call"), evaluation.valid_call(text, F.col("benchmark")).alias("valid"))


_NLL = f"(select doc_id, {sql_score('doc_id', 'i')} * 6 as nll, 1 + (i % 9) as rank, i // 64 as batch from (select doc_id, unnest(range(len(tokens))) as i from {TOKENIZED}))"


def _nll(spark, sf) -> DataFrame:
    t = tokenized(spark, sf).select("doc_id", F.explode(F.sequence(F.lit(0), F.size("tokens") - 1)).alias("i"))
    return t.select("doc_id", (score("doc_id", "i") * 6).alias("nll"), (1 + F.col("i") % 9).alias("rank"), F.floor(F.col("i") / 64).alias("batch"))


@query("a12_token_scores", f"""select count(*) as n_tokens, round(avg(nll), 6) as loss, round(count(*) filter (rank <= 1)::double / count(*), 6) as top1, round(count(*) filter (rank <= 5)::double / count(*), 6) as top5, round(exp(avg(nll)), 5) as perplexity, round(avg(nll) / ln(2), 6) as bits_per_token from {_NLL}""")
def a12(spark, sf):
    r = evaluation.token_scores(_nll(spark, sf), [])
    return r.select("n_tokens", *(F.round(c, 6).alias(c) for c in ("loss", "top1", "top5")), F.round("perplexity", 5).alias("perplexity"), F.round("bits_per_token", 6).alias("bits_per_token"))


@query("a13_target_loss", f"select doc_id, round(sum(nll) / count(*), 6) as loss, round(exp(least(sum(nll) / count(*), 20)), 4) as perplexity from {_NLL} group by 1")
def a13(spark, sf):
    per = _nll(spark, sf).groupBy("doc_id").agg(F.sum("nll").alias("s"), F.count("*").alias("n"))
    loss, ppl = evaluation.target_loss(F.col("s"), F.col("n"))
    return per.select("doc_id", F.round(loss, 6).alias("loss"), F.round(ppl, 4).alias("perplexity"))


_BATCHES = f"(select batch, avg(nll) as loss, count(*) filter (rank <= 1)::double / count(*) as accuracy, count(*) as n_targets from {_NLL} group by 1)"


def _batches(spark, sf) -> DataFrame:
    return _nll(spark, sf).groupBy("batch").agg(F.avg("nll").alias("loss"), (F.count_if(F.col("rank") <= 1) / F.count("*")).alias("accuracy"), F.count("*").alias("n_targets"))


@query("a14_weighted_batches", f"select sum(n_targets)::bigint as n_targets, round(sum(loss * n_targets) / sum(n_targets), 6) as loss, round(sum(floor(accuracy * n_targets)) / sum(n_targets), 6) as accuracy from {_BATCHES}")
def a14(spark, sf):
    r = evaluation.weighted_batches(_batches(spark, sf))
    return r.select("n_targets", F.round("loss", 6).alias("loss"), F.round(F.col("accuracy").cast("double"), 6).alias("accuracy"))


@query("a15_mean_of_batches", f"select round(avg(loss), 6) as loss from {_BATCHES}")
def a15(spark, sf):
    return evaluation.mean_of_batches(_batches(spark, sf)).select(F.round("loss", 6).alias("loss"))


@query("a21_perplexity", f"select round(exp(avg(nll)), 5) as perplexity from {_NLL}")
def a21(spark, sf):
    return evaluation.token_scores(_nll(spark, sf), []).select(F.round("perplexity", 5).alias("perplexity"))


@query("a29_token_accuracy", f"select round(count(*) filter (rank <= 1)::double / count(*), 6) as accuracy from {_NLL}")
def a29(spark, sf):
    return evaluation.token_scores(_nll(spark, sf), []).select(F.round("top1", 6).alias("accuracy"))


@query("j06_same_windows", f"with a as (select doc_id, avg(nll) as l from {_NLL} group by 1), b as (select doc_id, avg(nll + rank / 10.0) as l from {_NLL} group by 1) select a.doc_id, round(a.l - b.l, 6) as delta, round((a.l - b.l) * 100 / b.l, 5) as pct from a join b on a.doc_id = b.doc_id")
def j06(spark, sf):
    n = _nll(spark, sf)
    a, b = n.groupBy("doc_id").agg(F.avg("nll").alias("a")), n.groupBy("doc_id").agg(F.avg(F.col("nll") + F.col("rank") / 10.0).alias("b"))
    delta, pct = stats.change(F.col("a"), F.col("b"))
    return a.join(b, "doc_id").select("doc_id", F.round(delta, 6).alias("delta"), F.round(pct, 5).alias("pct"))


Q["a26_change"], SQL["a26_change"] = Q["j06_same_windows"], SQL["j06_same_windows"]


_TASKS = "(select benchmark as task, case when benchmark = 'secqa_dev' then 'ppl' else 'acc' end as metric, count(*) as n, count(*) filter (label = 0) as correct from eval_items group by 1, 2)"


@query("a22_suite", f"select count(*) as n_tasks, round(avg(correct::double / n), 9) as average from {_TASKS} where metric <> 'ppl' and n > 0")
def a22(spark, sf):
    t = table(spark, sf, "eval_items").groupBy("benchmark").agg(F.count("*").alias("n"), F.count_if(F.col("label") == 0).alias("correct"))
    return evaluation.suite(t.withColumn("metric", F.when(F.col("benchmark") == "secqa_dev", "ppl").otherwise("acc"))).withColumn("average", F.round("average", 9))


@query("a27_chance_corrected", f"select task, round(greatest(0, (correct::double / n - 0.25) / 0.75), 9) as score from {_TASKS}")
def a27(spark, sf):
    t = table(spark, sf, "eval_items").groupBy(F.col("benchmark").alias("task")).agg((F.count_if(F.col("label") == 0) / F.count("*")).alias("s"))
    return t.select("task", F.round(evaluation.chance_corrected(F.col("s"), F.lit(0.25)), 9).alias("score"))


_LOGITS = f"(select item_id, label, list_transform([0, 1, 2, 3], lambda c: {sql_score('item_id', 'c')} * 8 - 4) as x from eval_items)"


def _logits(spark, sf) -> DataFrame:
    x = F.array(*((score("item_id", f"c{i}") * 8 - 4) for i in range(4)))
    return table(spark, sf, "eval_items").select("item_id", "label", *(F.lit(i).alias(f"c{i}") for i in range(4))).select("item_id", "label", x.alias("x"))


@query("a28_cross_entropy", f"select item_id, round(ln(list_sum(list_transform(x, lambda v: exp(v)))) - x[label + 1] + 0.0001 * ln(list_sum(list_transform(x, lambda v: exp(v)))) ** 2, 6) as loss from {_LOGITS}")
def a28(spark, sf):
    return _logits(spark, sf).select("item_id", F.round(evaluation.cross_entropy(F.col("x"), F.col("label"), 1e-4), 6).alias("loss"))


@query("a28_masked_mean", f"select count(*) as n_targets, round(avg(ln(list_sum(list_transform(x, lambda v: exp(v)))) - x[label + 1]), 6) as loss from {_LOGITS} where item_id % 3 <> 0")
def a28_masked(spark, sf):
    """The mean over the targets that aren't ignored; a third is."""
    masked = _logits(spark, sf).withColumn("label", F.when(F.col("item_id") % 3 == 0, -100).otherwise(F.col("label")))
    return evaluation.masked_cross_entropy(masked, "x", "label").withColumn("loss", F.round("loss", 6))


def _long_logits(spark, sf) -> DataFrame:
    return _logits(spark, sf).select("item_id", "label", F.posexplode("x").alias("token", "logit"))


_LONG = f"(select item_id, label, unnest(x) as logit, generate_subscripts(x, 1) - 1 as token from {_LOGITS})"


@query("l04_top_k", f"select item_id, token::int as token from (select *, rank() over (partition by item_id order by logit desc) as r from {_LONG}) where r <= 2")
def l04(spark, sf):
    return sampling.top_k(_long_logits(spark, sf), "item_id", 2).select("item_id", "token")


_WIDE = f"(select item_id, label, token, {sql_score('item_id', 'token')} * 8 - 4 as logit from (select item_id, label, unnest(range(16)) as token from eval_items))"


def _wide_logits(spark, sf) -> DataFrame:
    """Sixteen scores of each item."""
    wide = table(spark, sf, "eval_items").select("item_id", "label", F.explode(F.sequence(F.lit(0), F.lit(15))).alias("token"))
    return wide.withColumn("logit", score("item_id", "token") * 8 - 4)


@query("l04_top5_members", f"select item_id, bool_or(token = label and r <= 5) as label_in_top from (select *, row_number() over (partition by item_id order by logit desc, token) as r from {_WIDE}) group by 1")
def l04_members(spark, sf):
    """Whether the right token is among the five best."""
    rows = sampling.top_members(_wide_logits(spark, sf), "item_id", 5)
    return rows.groupBy("item_id").agg(F.bool_or((F.col("token") == F.col("label")) & F.col("in_top")).alias("label_in_top"))


@query("w09_nucleus", f"""with p as (select item_id, token, exp(logit) / sum(exp(logit)) over (partition by item_id) as p from {_LONG}), c as (select *, coalesce(sum(p) over (partition by item_id order by p desc, token rows between unbounded preceding and 1 preceding), 0) as b from p) select item_id, token::int as token from c where b <= 0.8""")
def w09(spark, sf):
    p = _long_logits(spark, sf).withColumn("p", F.exp("logit") / F.sum(F.exp("logit")).over(Window.partitionBy("item_id")))
    return sampling.nucleus(p, "item_id", 0.8).select("item_id", "token")


@query("f12_penalties", f"select item_id, token::int as token, round(case when token = label and logit > 0 then logit / 1.2 when token = label then logit * 1.2 else logit end, 9) as signed, round(case when token = label then logit / 1.2 else logit end, 9) as divided from {_LONG}")
def f12(spark, sf):
    seen = F.col("token") == F.col("label")
    return _long_logits(spark, sf).select("item_id", "token", F.round(sampling.penalty_signed(F.col("logit"), seen, 1.2), 9).alias("signed"), F.round(sampling.penalty_divided(F.col("logit"), seen, 1.2), 9).alias("divided"))


@query("f13_argmax", f"select item_id, arg_max(token, logit)::int as token from {_LONG} group by 1")
def f13(spark, sf):
    return sampling.argmax(_long_logits(spark, sf), "item_id", "logit", "token").select("item_id", "token")


_UNIFORM = f"({sql_score('seed', 'item_id', 'token')} + 1.0 / 33554432)"


@query("f13_sampled", f"select item_id, arg_max(token, (logit / 0.7 - ln(-ln({_UNIFORM})), -token))::int as token from (select *, 11 as seed from {_WIDE}) group by 1")
def f13_sampled(spark, sf):
    """A token drawn from softmax(logit / 0.7) by a seeded hash."""
    seeded = _wide_logits(spark, sf).withColumn("seed", F.lit(11))
    return sampling.multinomial(seeded, "item_id", "logit", "token", score("seed", "item_id", "token") + 1.0 / 33554432, 0.7)


@query("f13_greedy", f"select item_id, arg_max(token, (logit, -token))::int as token from {_WIDE} group by 1")
def f13_greedy(spark, sf):
    return sampling.multinomial(_wide_logits(spark, sf), "item_id", "logit", "token", F.lit(0.5), 0.0).select("item_id", "token")


# a curve of losses by step, of the events
_CURVE = "(select event_id as step, round(value, 4) as loss from events)"


@query("s11_training_log", f"select step, loss as val_loss, (step * 7)::bigint as throughput from {_CURVE}")
def s11(spark, sf):
    e = table(spark, sf, "events").select(F.col("event_id").alias("n"), F.round("value", 4).alias("v"))
    line = F.concat(F.lit("Validation  step="), F.lpad(F.col("n").cast("string"), 8, " "), F.lit("  val_loss="), F.format_string("%.4f", "v"), F.lit("  tok/s="), F.format_number(F.col("n") * 7, 0))
    return item_sources.training_log(e.select(line.alias("line"))).select("step", "val_loss", "throughput")


@query("a25_upper_median", f"with c as (select step, row_number() over (order by step) as r, count(*) over () as n from {_CURVE}) select any_value(n) as n, max(case when r = n // 2 + 1 then step end) as upper_median, max(step) as max from c")
def a25(spark, sf):
    return stats.upper_median(table(spark, sf, "events").select(F.col("event_id").alias("step")), "step").withColumn("upper_median", F.col("upper_median").cast("long"))


@query("w08_new_best", f"select step, loss, coalesce(loss < min(loss) over (order by step rows between unbounded preceding and 1 preceding), true) as is_best from {_CURVE}")
def w08(spark, sf):
    return evaluation.repeated_best(table(spark, sf, "events").select(F.col("event_id").alias("step"), F.round("value", 4).alias("loss")), "step", "loss")


@query("w10_last_versions", f"select step from {_CURVE} order by step desc limit 5")
def w10(spark, sf):
    return table(spark, sf, "events").select(F.col("event_id").alias("step")).orderBy(F.desc("step")).limit(5)


@query("l08_by_step", f"select step from {_CURVE} order by step")
def l08(spark, sf):
    return table(spark, sf, "events").select(F.col("event_id").alias("step")).orderBy("step")


@query("w11_throughput", f"select (step // 100)::bigint as part, count(*) as n, round(avg(loss), 6) as mean from {_CURVE} group by 1")
def w11(spark, sf):
    return table(spark, sf, "events").groupBy(F.floor(F.col("event_id") / 100).alias("part")).agg(F.count("*").alias("n"), F.round(F.avg(F.round("value", 4)), 6).alias("mean"))


@query("j11_first_below", f"select min(step) as first_step from {_CURVE} where loss < (select round(quantile_cont(value, 0.01), 4) from events)")
def j11(spark, sf):
    e = table(spark, sf, "events")
    bar = quantiles(e, "value", [0.01]).select(F.round("q0", 4).alias("loss"))
    return compare.first_below(e.select(F.col("event_id").alias("step"), F.round("value", 4).alias("loss")), bar, "step", "loss")


@query("j07_report", """with n as (select event_type as metric, round(avg(value), 4) as v from events where event_id % 2 = 0 and event_type <> (select min(event_type) from events) group by 1), o as (select event_type as metric, round(avg(value), 4) as v from events where event_id % 2 = 1 group by 1)
 select coalesce(n.metric, o.metric) as metric, n.v as new, o.v as old, round(n.v - o.v, 6) as delta, case when n.v is null or o.v is null then 'not measured' when n.v < o.v then 'better' when n.v > o.v then 'worse' else 'same' end as verdict from n full join o on n.metric = o.metric""")
def j07(spark, sf):
    e = table(spark, sf, "events")
    least = e.agg(F.min("event_type").alias("least"))
    mean = lambda d: d.groupBy(F.col("event_type").alias("metric")).agg(F.round(F.avg("value"), 4).alias("v"))
    new = mean(e.where("event_id % 2 = 0").join(F.broadcast(least), F.col("event_type") == F.col("least"), "left_anti"))
    return compare.compare_reports(new, mean(e.where("event_id % 2 = 1")), "metric", "v").withColumn("delta", F.round("delta", 6))


@query("s17_report_rows", "select '| ' || event_type || ' | ' || printf('%.4f', avg(value)) || ' | not measured |' as row from events group by event_type")
def s17(spark, sf):
    m = table(spark, sf, "events").groupBy("event_type").agg(F.avg("value").alias("v"))
    return m.select(sinks.markdown_row(F.col("event_type"), F.col("v"), F.lit(None).cast("double")).alias("row"))


@query("s16_json_report", "select event_type, count(*) as n, round(avg(value), 6) as mean from events group by 1")
def s16_report(spark, sf):
    """Report rows as written by the sink and read back."""
    path = new_path(spark)
    m = table(spark, sf, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"))
    sinks.write_report(m, path)
    return spark.read.schema("event_type string, n long, mean double").json(path)


@query("s17_report", """with m as (select event_type, avg(value) filter (event_id % 2 = 0) as new, case when event_type = (select min(event_type) from events) then null else avg(value) filter (event_id % 2 = 1) end as old from events group by 1)
 select line_no::int as line_no, line from (values (-4, '# Events'), (-3, ''), (-2, '| metric | new | old |'), (-1, '|-|-|-|')) t(line_no, line)
 union all select row_number() over (order by event_type)::int, '| ' || event_type || ' | ' || coalesce(printf('%.4f', new), 'not measured') || ' | ' || coalesce(printf('%.4f', old), 'not measured') || ' |' from m
 union all select (1 << 30)::int, 'Not measured: ' || count(*) filter (new is null or old is null) from m""")
def s17_report(spark, sf):
    """A whole report with a metric that wasn't measured before."""
    e = table(spark, sf, "events")
    least = e.agg(F.min("event_type").alias("least"))
    m = e.groupBy("event_type").agg(F.avg(F.when(F.col("event_id") % 2 == 0, F.col("value"))).alias("new"), F.avg(F.when(F.col("event_id") % 2 == 1, F.col("value"))).alias("was"))
    m = m.crossJoin(F.broadcast(least)).select("event_type", "new", F.when(F.col("event_type") != F.col("least"), F.col("was")).alias("old"))
    return sinks.markdown_report(m, "event_type", "new", "old", "Events")


@query("s16_json_rows", "select event_type, count(*) as n from events group by 1")
def s16(spark, sf):
    """Report rows as JSON and back."""
    m = table(spark, sf, "events").groupBy("event_type").agg(F.count("*").alias("n"))
    return m.select(F.from_json(F.to_json(F.struct("event_type", "n")), "event_type string, n long").alias("r")).select("r.*")


@query("l05_activity_labels", f"select lower(trim(activity_label, {WS})) as label, count(*) as n from eval_items group by 1")
def l05_labels(spark, sf):
    """Uneven spellings of one label together, nulls kept."""
    return table(spark, sf, "eval_items").groupBy(F.lower(strip("activity_label")).alias("label")).agg(F.count("*").alias("n"))
