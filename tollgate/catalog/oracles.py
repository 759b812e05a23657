"""The SQL that checks the registered queries, over the same whole tables.

Written from the definitions, not from the Spark plans: dense item x model
tables by joins, a choice per item and budget by ranking, sums by windows.
"""

from __future__ import annotations

from tollgate.catalog.fixtures import ORDER_MODELS, PERF_SCALE, VECTOR_BASE_COSTS
from tollgate.catalog.queries import BUDGET_CENTS, ID_STEMS, NEIGHBOURS, ROOT, SPELLINGS
from tollgate.functions.names import EXTRA_ALIASES, PREFIX_FOLDERS, canonical_name
from tollgate.functions.text import WORD
from tollgate.sources.synthetic import TOY_MODELS

# ---- shared table expressions ---------------------------------------------

ORDER_LONG = """
long as (
  select l_orderkey item_id, o_orderpriority dataset,
         'm' || cast(l_linenumber as varchar) model,
         max(case when l_returnflag = 'R' then 0 else 1 end) is_correct,
         min(cast(round(l_extendedprice * 100) as bigint)) cost_cents
  from lineitem join orders on l_orderkey = o_orderkey
  group by 1, 2, 3)"""

_ORDER_NAMES = ", ".join(f"({i}, '{m}')" for i, m in enumerate(ORDER_MODELS))

ORDER_DENSE = f"""{ORDER_LONG},
models(model_idx, model) as (values {_ORDER_NAMES}),
dense as (
  select i.item_id, i.dataset, m.model_idx, m.model, l.is_correct, l.cost_cents
  from (select distinct item_id, dataset from long) i cross join models m
  left join long l on l.item_id = i.item_id and l.model = m.model)"""

ORDER_UNITS = f"""{ORDER_DENSE},
opt as (
  select item_id, dataset, model_idx, model,
         cast(round(coalesce(is_correct, avg(is_correct) over (partition by model)) * {PERF_SCALE}) as bigint) perf,
         cast(round(coalesce(cost_cents, avg(cost_cents) over (partition by model))) as bigint) cost
  from dense)"""


def split(source: str, key: str = "item_id", share: float = 0.2) -> str:
    return f"""
split as (
  select {key}, row_number() over (order by md5('42:' || cast({key} as varchar)))
         <= floor({share} * count(*) over () + 1e-9) is_train
  from (select distinct {key} from {source}))"""


ORDER_TEST = f"""{ORDER_UNITS},{split('opt')},
test as (select opt.* from opt join split using (item_id) where not is_train)"""

_BASE = " ".join(f"when {m} then {c}" for m, c in enumerate(VECTOR_BASE_COSTS))

VECTORS = f"""
vec as (
  select vec_id item_id, label, embedding t, list_reverse(embedding) i,
         [cast(x * cast(1 + vec_id % 7 as float) as float) for x in embedding] ts,
         [cast(x * cast(1 + vec_id % 5 as float) as float) for x in list_reverse(embedding)] "is"
  from embeddings),
opt as (
  select vec_id item_id, label, m model_idx,
         cast((vec_id * 7919 + m * 104729 + 13) % 1000
              < 450 + 100 * m - 25 * ((label + 3 * m) % 10) as bigint) perf,
         cast(case m {_BASE} end * (800 + (vec_id * 31 + m * 17) % 401) as bigint) cost
  from embeddings cross join range(4) r(m)),{split('vec')},
train as (select opt.* from opt join split using (item_id) where is_train),
test as (select opt.* from opt join split using (item_id) where not is_train)"""

# Sweep by definition: every budget against every item.
NAIVE_POINTS = """
budgets as (select distinct cost_pred c from pred where cost_pred is not null),
choice as (
  select c, item_id, perf, cost from budgets cross join pred
  qualify row_number() over (
    partition by c, item_id
    order by case when cost_pred <= c then perf_pred else cast('-infinity' as double) end desc, model_idx) = 1),
points as (
  select c threshold, count(*) n, cast(sum(perf) as bigint) perf_sum, cast(sum(cost) as bigint) cost_sum
  from choice group by c)"""

# The same for very many budgets: every item at its own budgets, then summed up.
OWN_POINTS = """
own as (select distinct item_id, cost_pred c from pred),
choice as (
  select o.item_id, o.c, p.perf, p.cost from own o join pred p on p.item_id = o.item_id
  qualify row_number() over (
    partition by o.item_id, o.c
    order by case when p.cost_pred <= o.c then p.perf_pred else -1 end desc, p.model_idx) = 1),
change as (
  select ch.c,
         ch.perf - coalesce(lag(ch.perf) over w, b.perf) dp,
         ch.cost - coalesce(lag(ch.cost) over w, b.cost) dc
  from choice ch join (select item_id, perf, cost from pred where model_idx = 0) b on b.item_id = ch.item_id
  window w as (partition by ch.item_id order by ch.c)),
base as (select count(*) n, sum(perf) perf, sum(cost) cost from pred where model_idx = 0),
points as (
  select c threshold, base.n,
         cast(base.perf + sum(dp) over (order by c) as bigint) perf_sum,
         cast(base.cost + sum(dc) over (order by c) as bigint) cost_sum
  from (select c, sum(dp) dp, sum(dc) dc from change group by c) cross join base)"""


def points(pred: str, sweep: str, scale: int) -> str:
    """Table expressions from predictions to the points with their means."""
    return f"""{pred},{sweep},
curve as (
  select threshold, n, perf_sum, cost_sum,
         cast(cost_sum as double) / n cost, cast(perf_sum as double) / (n * {scale}) performance
  from points)"""


CURVE = """
select cast(threshold as double) threshold, n, perf_sum, cost_sum, cost, performance from curve"""

ALL_ORDERS_CURVE = points(
    f"{ORDER_UNITS},\npred as (select *, perf perf_pred, cost cost_pred from opt)", OWN_POINTS, PERF_SCALE
)
TEST_ORDERS_CURVE = points(
    f"{ORDER_TEST},\npred as (select *, perf perf_pred, cost cost_pred from test)", OWN_POINTS, PERF_SCALE
)

FRONTIER = """
front as (
  select cost, performance from (
    select cost, performance,
           max(performance) over (order by cost, performance desc
                                  rows between unbounded preceding and 1 preceding) before
    from curve)
  where before is null or performance > before),
steps as (
  select cost, performance, lag(cost) over (order by cost) c0, lag(performance) over (order by cost) p0
  from front)"""

RANDOM_CURVE = f"""{ORDER_TEST},
curve as (
  select trial, cast(sum(cost) as double) / count(*) cost,
         cast(sum(perf) as double) / (count(*) * {PERF_SCALE}) performance
  from (
    select trial, item_id,
           cast('0x' || substr(md5('42:' || trial || ':' || item_id), 1, 8) as bigint) % 7 pick
    from (select distinct item_id from test) cross join range(50) r(trial))
  join test using (item_id)
  where model_idx = pick
  group by trial)"""

BASELINES = f"""
baselines as (
  select model_idx, model, cast(sum(perf) as double) / (count(*) * {PERF_SCALE}) accuracy,
         cast(sum(cost) as double) / count(*) avg_cost
  from test group by model_idx, model)"""

METRICS = """
select round(sum((cost - c0) * (performance + p0) / 2) / (max(cost) - min(cost)), 6) nauc,
       round(max(performance), 6) ps,
       round(coalesce(min(case when performance >= b.accuracy then cost end) / any_value(b.avg_cost),
                      cast('infinity' as double)), 6) qnc,
       count(*) points
from steps cross join (select * from baselines order by accuracy desc, model_idx limit 1) b"""


# ---- names and ids ---------------------------------------------------------


def _text_list(values) -> str:
    return "[" + ", ".join(f"'{x}'" for x in values) + "]"


def _text_rows(pairs) -> str:
    return ", ".join(f"('{a}', '{b}')" for a, b in pairs)


_ALIASES = {canonical_name(p): p for p in PREFIX_FOLDERS} | EXTRA_ALIASES

IDS = f"""
prefixes(prefix, folder) as (values {_text_rows(PREFIX_FOLDERS.items())}),
ids as (
  select *, case when doc_id % 13 = 0 then null
                 when doc_id % 7 = 0 then stem
                 else stem || '_' || doc_id end dataset_idx
  from (select *, {_text_list(ID_STEMS)}[doc_id % {len(ID_STEMS)} + 1] stem from documents)),
matched as (
  select ids.*, p.prefix, p.folder,
         case when p.prefix is null then null
              when dataset_idx = p.prefix then list_extract(string_split(dataset_idx, '_'), -1)
              else substr(dataset_idx, length(p.prefix) + 2) end image
  from ids left join prefixes p on dataset_idx = p.prefix or starts_with(dataset_idx, p.prefix || '_')
  qualify row_number() over (partition by doc_id order by length(p.prefix) desc nulls last) = 1)"""

DRAWN = """
drawn as (
  select doc_id, lang, text, m model_idx,
         case when (doc_id + m) % 9 <> 0
              then cast((doc_id * 7919 + 104729 * m) % 1000 < 500 + 100 * m as double) end is_correct,
         case when (doc_id + m) % 11 <> 0
              then cast((800 + (doc_id * 31 + 17 * m) % 401) * (m + 1) as double) end cost
  from documents cross join range(3) r(m))"""

WANTED_PREFIXES = "('MathVista', 'SEEDBench2_Plus', 'MMStar')"

# ---- text ------------------------------------------------------------------

TERMS = f"""
tokens as (select doc_id doc, regexp_extract_all(lower(text), '{WORD}') w from documents),
counts as (
  select doc, term, count(*) tf from (
    select doc, unnest(w) term from tokens
    union all
    select doc, unnest([w[k] || ' ' || w[k + 1] for k in range(1, len(w))]) from tokens)
  group by doc, term)"""

TOP = """
top as (
  select term, cast(sum(tf) as bigint) frequency, count(*) docs
  from counts group by term order by frequency desc, term limit 20000)"""

# ---- vectors ---------------------------------------------------------------


def _unnested(t: str, i: str) -> str:
    return f"""
cells as (
  select item_id, pos, cast(t[pos] as double) t, cast(i[pos] as double) i
  from (select item_id, {t} t, {i} i, unnest(range(1, len({t}) + 1)) pos from vec))"""


SCALED_CELLS = _unnested("ts", '"is"')

ADAPTIVE = f"""{VECTORS},{SCALED_CELLS},
mu as (select pos, avg(t) mt, avg(i) mi from cells group by pos),
mun as (select sqrt(sum(mt * mt)) nt, sqrt(sum(mi * mi)) ni from mu),
norms as (
  select item_id, sqrt(sum(t * t)) nt, sqrt(sum(i * i)) ni, sum(t * mt) dt, sum(i * mi) di
  from cells join mu using (pos) group by item_id),
spread as (
  select avg(nt) mean_t, stddev_pop(nt) std_t, avg(ni) mean_i, stddev_pop(ni) std_i from norms),
conf as (
  select item_id,
    greatest(0, least(1, 0.5 * (dt / (norms.nt * mun.nt + 1e-8) + 1) / 2
                         + 0.5 / (1 + exp(-(norms.nt - mean_t) / (std_t + 1e-8))))) ct,
    greatest(0, least(1, 0.5 * (di / (norms.ni * mun.ni + 1e-8) + 1) / 2
                         + 0.5 / (1 + exp(-(norms.ni - mean_i) / (std_i + 1e-8))))) ci
  from norms cross join mun cross join spread),
fused as (
  select item_id, pos,
    exp(5 * ct) / (exp(5 * ct) + exp(5 * ci) + 1e-8) * t
    + exp(5 * ci) / (exp(5 * ct) + exp(5 * ci) + 1e-8) * i
    + 0.5 * t * i + 0.5 * abs(t - i) f
  from cells join conf using (item_id))
select item_id, cast(pos - 1 as integer) pos,
       round(f / (sqrt(sum(f * f) over (partition by item_id)) + 1e-8), 6) "value" from fused"""

AVERAGE = "[(cast(t[k] as double) + cast(i[k] as double)) / 2 for k in range(1, len(t) + 1)]"


def neighbours(distance: str) -> str:
    return f"""{VECTORS},
feat as (select item_id, is_train, {AVERAGE} x from vec join split using (item_id)),
near as (
  select a.item_id, b.item_id train_id, round({distance}, 12) distance
  from feat a cross join feat b where not a.is_train and b.is_train),
ranked as (
  select *, row_number() over (partition by item_id order by distance, train_id) rank
  from near qualify rank <= {NEIGHBOURS})"""


COSINE = neighbours("1 - list_cosine_similarity(a.x, b.x)")
EUCLIDEAN = neighbours("list_distance(a.x, b.x)")

KNN_MEANS = f"""{COSINE},
means as (
  select ranked.item_id, model_idx, avg(perf) perf_pred, avg(cost) cost_pred
  from ranked join train on train.item_id = train_id group by 1, 2)"""

PROFILE = f"""{VECTORS},
profile as (
  select label, model_idx, avg(perf) perf_pred, avg(cost) cost_pred from train group by 1, 2)"""


# Every pair of 1, the 64 features and the 8 targets, multiplied and summed by definition.
MOMENTS = f"""{VECTORS},
targets as (
  select item_id, list(cast(perf as double) order by model_idx) p, list(cast(cost as double) order by model_idx) c
  from train group by item_id),
z as (
  select item_id, list_concat([1.0::double], list_concat(list_transform(t, lambda x: cast(x as double)), list_concat(p, c))) z
  from targets join vec using (item_id)),
e as (select item_id, unnest(z) v, unnest(range(0, len(z))) i from z)
select cast(a.i as integer) i, cast(b.i as integer) j, round(sum(a.v * b.v), 4) "value"
from e a join e b using (item_id) group by a.i, b.i"""

# What is left over by a fit that solves its normal equations.
NOTHING_LEFT = """
select cast(f as integer) feature, cast(t as integer) target, cast(0 as double) left_over
from range(64) a(f) cross join range(8) b(t)"""


def _averaged(image: str) -> str:
    """Mean of the text vector with ``image``, both as long as the shorter one."""
    return f"""
with vec as (select vec_id item_id, embedding t, {image} i from embeddings)
select item_id, cast(pos - 1 as integer) pos,
       round((cast(t[pos] as double) + cast(i[pos] as double)) / 2, 6) "value"
from (select item_id, t, i, unnest(range(1, least(len(t), len(i)) + 1)) pos from vec)"""


_TOY = sorted(TOY_MODELS, key=lambda m: m.name)
_TOY_ROWS = ", ".join(f"({i}, '{m.name}', {m.accuracy}, {m.cost})" for i, m in enumerate(_TOY))


def _uniform(what: str) -> str:
    return f"cast(cast('0x' || substr(md5({what}), 1, 8) as bigint) as double) / 4294967296"


SQL = {
    "infer_long_outcomes": f"""
with {ORDER_DENSE}
select item_id, dataset, 'order ' || item_id question, '' answer, model_idx,
       replace(model, 'm', 'line.') model, cast(is_correct as double) is_correct, cast(cost_cents as double) cost
from dense""",
    "impute_means": f"""
with {ORDER_DENSE}
select item_id, dataset, model,
       round(coalesce(is_correct, avg(is_correct) over (partition by model)), 6) is_correct,
       round(coalesce(cost_cents, avg(cost_cents) over (partition by model)), 4) cost
from dense""",
    "coalesce_targets": f"""
with {ORDER_DENSE}
select item_id, model, cast(coalesce(is_correct, 0) as double) is_correct,
       cast(coalesce(cost_cents, 0) as double) cost
from dense""",
    "model_cost_norm": f"""
with {ORDER_UNITS}
select model_idx, model, round(c, 4) mean_cost, round(c / max(c) over (), 6) cost_norm
from (select model_idx, model, avg(cost) c from opt group by 1, 2)""",
    "single_model_baselines": f"""
with {ORDER_TEST},{BASELINES}
select model_idx, model, round(accuracy, 6) accuracy, round(avg_cost, 6) avg_cost from baselines""",
    "best_single_model": f"""
with {ORDER_TEST},{BASELINES}
select model_idx, model, round(accuracy, 6) accuracy, round(avg_cost, 6) avg_cost
from baselines order by baselines.accuracy desc, model_idx limit 1""",
    "csv_outcomes": f"""
with {DRAWN}
select doc_id item_id, lang dataset, md5(text) question_md5, lang answer, '' img_path,
       cast(model_idx as integer) model_idx, 'gate-' || model_idx || '.0' model, is_correct, cost
from drawn""",
    "merged_outcomes": f"""
with {IDS},{DRAWN}
select matched.doc_id item_id, any_value(folder) dataset, any_value(md5(matched.text)) question_md5,
       any_value('/' || folder || '/' || image || '.jpg') img_path,
       {", ".join(f"max(is_correct) filter (where model_idx = {m}) perf_{m}" for m in range(3))},
       {", ".join(f"max(cost) filter (where model_idx = {m}) cost_{m}" for m in range(3))}
from matched join drawn on drawn.doc_id = matched.doc_id
where prefix in {WANTED_PREFIXES} group by matched.doc_id""",
    "filter_datasets": f"""
with {IDS}
select doc_id, dataset_idx, folder dataset from matched where prefix in {WANTED_PREFIXES}""",
    "union_datasets": """
select 'documents' dataset, md5(text) question_md5, lang, null role, null url from documents
union all select 'conversations', md5(text), null, role, null from conversations
union all select 'pages', md5(html), null, null, url from pages""",
    "synthetic_outcomes": f"""
with models(model_idx, model, accuracy, base) as (values {_TOY_ROWS})
select o_orderkey item_id, model_idx, model,
       cast({_uniform("'42:answer:' || model || ':' || o_orderkey")}
            < greatest(0.05, least(0.99, accuracy - 0.25 * {_uniform("'42:difficulty:' || o_orderkey")}))
            as double) is_correct,
       round(base * (0.8 + 0.4 * {_uniform("'42:cost:' || model || ':' || o_orderkey")}), 9) cost
from orders cross join models""",
    "canon_names": f"""
with aliases(name, prefix) as (values {_text_rows(_ALIASES.items())}),
named as (
  select doc_id, source, lang,
         regexp_replace(lower({_text_list(SPELLINGS)}[doc_id % {len(SPELLINGS)} + 1]), '[^a-z0-9]', '', 'g') name
  from documents)
select doc_id, regexp_replace(lower(source || lang), '[^a-z0-9]', '', 'g') source_name, name, prefix
from named left join aliases using (name)""",
    "prefix_match": f"with {IDS} select doc_id, dataset_idx, prefix from matched",
    "image_path_strings": f"""
with {IDS}
select doc_id, coalesce(folder, 'unknown') folder,
       coalesce('{ROOT}/' || folder || '/' || image || '.jpg', '') img_path
from matched""",
    "image_path_listing": f"""
with {IDS},
files as (
  select distinct '{ROOT}/' || folder || '/' || image file,
         unnest(case doc_id % 3 when 0 then ['.webp', '.png'] when 1 then ['.jpeg', '.txt'] end) ending
  from matched where image is not null),
found as (
  select file, min(list_position(['.jpg', '.png', '.jpeg', '.webp'], ending)) k
  from files where ending <> '.txt' group by file)
select doc_id, dataset_idx,
       case when image is null then ''
            else '{ROOT}/' || folder || '/' || image || ['.jpg', '.png', '.jpeg', '.webp'][coalesce(k, 1)] end img_path
from matched left join found on file = '{ROOT}/' || folder || '/' || image""",
    "resolve_paths": f"""
select page_id, case page_id % 4 when 0 then '/mnt/shots/' || page_id || '.png'
                                 when 1 then ''
                                 when 2 then '{ROOT}/pages/shots/' || page_id || '.jpg'
                                 else '{ROOT}/other/' || page_id || '.jpg' end img_path
from pages""",
    "split_in": f"""
with{split('documents', 'doc_id')}
select doc_id item_id, source dataset, is_train from documents join split using (doc_id)""",
    "split_out": """
select doc_id item_id, source dataset, source in ('src0', 'src1', 'src2', 'src3', 'src4') is_train
from documents""",
    "oracle_sweep": f"with {ALL_ORDERS_CURVE} {CURVE}",
    "random_sweep": f"""
with {RANDOM_CURVE}
select cast(trial as integer) trial, cost, performance from curve""",
    "argmax_under_budget": f"""
with {ORDER_UNITS}
select item_id, dataset, model_idx, perf, cost, cost <= {BUDGET_CENTS} feasible from opt
qualify row_number() over (partition by item_id, dataset
  order by case when cost <= {BUDGET_CENTS} then perf else -1 end desc, model_idx) = 1""",
    "pareto_frontier": f"""
with {ALL_ORDERS_CURVE},{FRONTIER}
select cost, performance from front""",
    "trapezoid_auc": f"""
with {ALL_ORDERS_CURVE},{FRONTIER}
select count(*) points, round(min(cost), 6) min_cost, round(max(cost), 6) max_cost,
       round(max(performance), 6) peak, round(sum((cost - c0) * (performance + p0) / 2), 2) area
from steps""",
    "metrics_summary": f"with {TEST_ORDERS_CURVE},{FRONTIER},{BASELINES} {METRICS}",
    "random_metrics": f"with {RANDOM_CURVE},{FRONTIER},{BASELINES} {METRICS}",
    "budget_sweep_given_predictions": "with "
    + points(
        f"""{ORDER_TEST},
profile as (
  select dataset, model_idx, avg(perf) perf_pred, avg(cost) cost_pred
  from opt join split using (item_id) where is_train group by 1, 2),
pred as (select test.*, perf_pred, cost_pred from test join profile using (dataset, model_idx))""",
        NAIVE_POINTS,
        PERF_SCALE,
    )
    + CURVE,
    "average_fusion": _averaged("list_reverse(embedding)"),
    "adaptive_fusion": f"with {ADAPTIVE}",
    "cross_fusion": """
with cells as (
  select vec_id item_id, len(embedding) d, pos, cast(embedding[pos] as double) t,
         cast(embedding[len(embedding) + 1 - pos] as double) i
  from (select *, unnest(range(1, len(embedding) + 1)) pos from embeddings))
select item_id, cast(part * d + pos - 1 as integer) pos,
       round(case part when 0 then t when 1 then i when 2 then t * i else abs(t - i) end, 6) "value"
from cells cross join range(4) r(part)""",
    "l2_normalise": f"""
with {VECTORS},{SCALED_CELLS}
select item_id, cast(pos - 1 as integer) pos,
       round(t / sqrt(sum(t * t) over (partition by item_id)), 6) "value" from cells""",
    "batch_stats": f"""
with {VECTORS},{SCALED_CELLS},
norms as (select item_id, sqrt(sum(t * t)) nt, sqrt(sum(i * i)) ni from cells group by item_id),
spread as (
  select avg(nt) mean_t, stddev_pop(nt) std_t, avg(ni) mean_i, stddev_pop(ni) std_i from norms)
select 'text' modality, cast(pos - 1 as integer) pos, round(avg(t), 6) mean,
       round(any_value(mean_t), 6) norm_mean, round(any_value(std_t), 6) norm_std
from cells cross join spread group by pos
union all
select 'img', cast(pos - 1 as integer), round(avg(i), 6), round(any_value(mean_i), 6), round(any_value(std_i), 6)
from cells cross join spread group by pos""",
    "truncate_dims": _averaged("list_reverse(embedding)[1:1 + vec_id % 60]"),
    "zero_modality": _averaged(
        "case when vec_id % 3 > 0 then list_reverse(embedding) else [cast(0 as float) for x in embedding] end"
    ),
    "text_encoder": f"""
with {TERMS},
slots as (
  select doc, cast('0x' || substr(md5(term), 1, 8) as bigint) % 32 pos, sum(tf) c from counts group by 1, 2)
select doc item_id, cast(pos as integer) pos,
       round(cast(cast(c / sqrt(sum(c * c) over (partition by doc)) as float) as double), 6) "value" from slots""",
    "top_terms": f"with {TERMS},{TOP} select term, frequency, docs from top",
    "tfidf_weights": f"""
with {TERMS},{TOP},
raw as (
  select doc, term, tf, tf * (ln((1.0 + (select count(*) from documents)) / (1.0 + docs)) + 1) w
  from counts join top using (term))
select doc, term, tf, round(w / sqrt(sum(w * w) over (partition by doc)), 6) weight from raw""",
    "cluster_profile": f"""
with {PROFILE}
select label "cluster", cast(model_idx as integer) model_idx,
       round(perf_pred, 6) perf_pred, round(cost_pred, 6) cost_pred
from profile""",
    "cluster_route_sweep": "with "
    + points(
        f"{PROFILE},\npred as (select test.*, perf_pred, cost_pred from test join profile using (label, model_idx))",
        NAIVE_POINTS,
        1,
    )
    + CURVE,
    "knn_neighbours": f"""
with {COSINE}
select item_id, cast(rank as integer) rank, train_id, round(distance, 6) distance from ranked""",
    "knn_neighbours_euclidean": f"""
with {EUCLIDEAN}
select item_id, cast(rank as integer) rank, train_id, round(distance, 6) distance from ranked""",
    "knn_predict": f"""
with {KNN_MEANS}
select item_id, cast(model_idx as integer) model_idx, round(perf_pred, 6) perf_pred, round(cost_pred, 6) cost_pred
from means""",
    "knn_sweep": "with "
    + points(
        f"{KNN_MEANS},\npred as (select test.*, perf_pred, cost_pred from test join means using (item_id, model_idx))",
        NAIVE_POINTS,
        1,
    )
    + CURVE,
    "moments_full": f"with {MOMENTS}",
    "linear_residuals": NOTHING_LEFT,
    "ridge_residuals": NOTHING_LEFT,
    "tfidf_least_squares": f"""
with {TERMS},{TOP}
select term_idx, cast(t as integer) target, cast(0 as double) left_over
from (select cast(row_number() over (order by term) - 1 as integer) term_idx from top) cross join range(6) b(t)""",
    "tfidf_ridge_residuals": """
select cast(d as integer) direction, cast(t as integer) target, cast(0 as double) left_over
from range(128) a(d) cross join range(-1, 6) b(t) where t >= 0 or d < 127""",
    "knn_neighbours_blocks": f"""
with {COSINE}
select item_id, cast(rank as integer) rank, train_id, round(distance, 6) distance from ranked""",
    "parquet_outcomes": f"""
with {DRAWN}
select doc_id item_id, 'whole' dataset, md5(text) question_md5, lang answer, '' img_path,
       cast(model_idx as integer) model_idx, 'gate-' || model_idx || '.0' model, is_correct, cost
from drawn""",
    "sweep_unmatched": "with "
    + points(
        f"""{ORDER_TEST},
profile as (
  select dataset, model_idx, avg(perf) perf_pred, avg(cost) cost_pred
  from opt join split using (item_id) where is_train and dataset <> '1-URGENT' group by 1, 2),
pred as (select test.*, perf_pred, cost_pred from test left join profile using (dataset, model_idx))""",
        NAIVE_POINTS,
        PERF_SCALE,
    )
    + CURVE,
    "split_out_merged": f"""
with {IDS}
select doc_id, coalesce(folder, 'unknown') dataset, coalesce(folder = 'SEEDBenchv2Plus', false) is_train from matched""",
    "saved_run": f"""
with {TEST_ORDERS_CURVE},{FRONTIER},{BASELINES},
m as ({METRICS})
select 'oracle' router, 'orders' dataset, '22' mode, nauc, ps, qnc,
       cast((select count(*) from baselines) as integer) models,
       (select count(*) from front) frontier_points, (select count(*) from curve) curve_points
from m""",
}
