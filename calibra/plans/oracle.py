"""DuckDB oracle SQL for the registered queries (same column names, floats
rounded to 6 digits)."""

from __future__ import annotations

# The encounter view (orders x customer, md5-marked missing values).
ENC = """enc as (
  select o_orderkey as id,
         case when md5(cast(o_orderkey as varchar) || ':bal') < '08' then null else c_acctbal end as acctbal,
         case when md5(cast(o_orderkey as varchar) || ':seg') < '08' then null else c_mktsegment end as seg,
         o_totalprice as price, o_orderpriority as priority,
         cast(o_orderstatus = 'F' as int) as y
  from orders join customer on o_custkey = c_custkey)"""

TOXIC = """toxic as (
  select d.doc_id, d.n_chars,
         cast(len(regexp_extract_all(d.text, '[^ \t\n\r]+')) as bigint) as words,
         case when length(d.text) = 0 then 0.0 else length(regexp_replace(d.text, '[^0-9]', '', 'g')) / length(d.text) end as digit_ratio,
         case when length(d.text) = 0 then 0.0 else length(regexp_replace(d.text, '[A-Za-z0-9 \t\n\r]', '', 'g')) / length(d.text) end as punct_ratio,
         cast(length(d.text) - length(replace(d.text, chr(10), '')) + 1 as bigint) as lines,
         d.lang, cast(l.quality as int) as quality, cast(l.toxic as int) as toxic
  from documents d join labels l on d.doc_id = l.doc_id)"""



ENC_CLEAN = ENC + """,
mode_seg as (select seg m from (select seg, count(*) n from enc where seg is not null group by seg) order by n desc, seg limit 1),
clean as (
  select id,
         coalesce(acctbal, (select median(acctbal) from enc)) as acctbal,
         coalesce(price, (select median(price) from enc)) as price,
         coalesce(seg, (select m from mode_seg)) as seg_f, priority, y
  from enc),
coded as (
  select id, acctbal, price,
         cast(seg_f = 'BUILDING' as int) as "seg_BUILDING",
         cast(seg_f = 'FURNITURE' as int) as "seg_FURNITURE",
         cast(seg_f = 'HOUSEHOLD' as int) as "seg_HOUSEHOLD",
         cast(seg_f = 'MACHINERY' as int) as "seg_MACHINERY",
         cast(priority = '2-HIGH' as int) as "priority_2-HIGH",
         cast(priority = '3-MEDIUM' as int) as "priority_3-MEDIUM",
         cast(priority = '4-NOT SPECIFIED' as int) as "priority_4-NOT SPECIFIED",
         cast(priority = '5-LOW' as int) as "priority_5-LOW",
         y
  from clean)"""

CODED_COLS = ["acctbal", "price", "seg_BUILDING", "seg_FURNITURE", "seg_HOUSEHOLD",
              "seg_MACHINERY", "priority_2-HIGH", "priority_3-MEDIUM",
              "priority_4-NOT SPECIFIED", "priority_5-LOW"]

SPLIT = """case when md5(cast(id as varchar) || ':42') < '33333333' then 'test'
            when md5(cast(id as varchar) || ':42') < '4ccccccc' then 'val' else 'train' end"""


def _params_sql() -> str:
    parts = []
    for c in CODED_COLS:
        parts.append(f"""select '{c}' as feature, avg(cast("{c}" as double)) as mean,
            stddev_pop(cast("{c}" as double)) as std from sp where split = 'train'""")
    return " union all ".join(parts)


def _standardize_sql() -> str:
    sel = []
    for c in CODED_COLS:
        sel.append(f"""round((cast(sp."{c}" as double) - (select mean from params where feature = '{c}'))
          / (select case when std = 0 then 1.0 else std end from params where feature = '{c}'), 6) as "{c}" """)
    return ("with " + ENC_CLEAN + f", sp as (select *, {SPLIT} as split from coded), params as ("
            + _params_sql() + ") select id, " + ", ".join(sel) + ", y, split from sp")


def _anova_sql(src: str, cols: list[str], label: str) -> str:
    """F from the deviations of every row, by window means."""
    u = " union all ".join(
        f"select {label} as y, '{c}' as f, {i} as idx, cast({c} as double) as x from {src} where {c} is not null"
        for i, c in enumerate(cols))
    return f"""u as ({u}),
d as (select f, idx, y, x, avg(x) over (partition by f, y) as m, avg(x) over (partition by f) as g from u),
scores as (select f as feature, idx, case
   when sum((x - m) * (x - m)) > 0 then (sum((m - g) * (m - g)) / (count(distinct y) - 1)) / (sum((x - m) * (x - m)) / (count(*) - count(distinct y)))
   when sum((m - g) * (m - g)) > 0 then 'inf'::double end as f_score from d group by f, idx)"""


TOXIC_NUM = ["n_chars", "words", "digit_ratio", "punct_ratio", "lines"]
LINE_FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _prepare_sql(q: dict[str, str]) -> None:
    q["curated_projection"] = f"with {ENC} select id, acctbal, price, seg, priority, y from enc"
    q["drop_null_target"] = (f"with {ENC} select id, acctbal, price, seg, priority, cast(y as int) y "
                             "from enc where not md5(cast(id as varchar) || ':y') < '08'")
    q["head"] = f"with {ENC} select * from enc order by id limit 5"
    q["impute_median_discrete"] = ("with l as (select l_orderkey % 2 a, l_orderkey % 3 b from lineitem) "
                                   "select 'parity' as feature, cast(median(a) as double) as median from l "
                                   "union all select 'third', cast(median(b) as double) from l union all select 'same', 7.0::double")
    q["missing_fraction_nan"] = (f"with {ENC} " + " union all ".join(
        f"select '{c}' as feature, round(avg(case when {c} is null then 1.0 else 0.0 end), 6) as missing_frac from enc"
        for c in ["id", "acctbal", "seg", "price", "priority", "y"]))
    q["split_exact_fractions"] = ("with r as (select o_orderkey as id, o_orderstatus as y, row_number() over (partition by o_orderstatus "
                                  "order by md5(cast(o_orderkey as varchar) || ':7'), o_orderkey) rn, count(*) over (partition by o_orderstatus) n "
                                  "from orders) select id, y, case when rn <= ceil(0.35*n) then 'test' when rn <= ceil(0.35*n) + ceil(0.15*n) "
                                  "then 'val' else 'train' end as split from r")
    q["clip_columns"] = ("select c_custkey, greatest(0.0, least(c_acctbal, 5000.0)) as acctbal_clipped "
                         "from customer")
    u = "('0x' || substr(md5(cast(id as varchar) || ':42:{c}'), 1, 13))::BIGINT / 4503599627370496.0"
    q["inject_missing"] = (f"with {ENC} select id, case when {u.format(c='price')} < 0.03 then null else price end price, "
                           f"case when {u.format(c='priority')} < 0.03 then null else priority end priority from enc")
    q["missing_fraction"] = (f"with {ENC} " + " union all ".join(
        f"select '{c}' as feature, round(avg(case when {c} is null then 1.0 else 0.0 end), 6) as missing_frac from enc"
        for c in ["id", "acctbal", "seg", "price", "priority", "y"]))
    q["impute_median"] = (f"with {ENC} select 'acctbal' as feature, round(median(acctbal), 6) as median from enc "
                          "union all select 'price', round(median(price), 6) from enc")
    q["impute_median_appended"] = " union all ".join(
        f"select '{c}' as feature, round(cast(median({c}) as double), 6) as median from lineitem" for c in LINE_FEATURES)
    q["impute_mode"] = (f"with {ENC}, c as (select 'seg' f, seg v, count(*) n from enc where seg is not null group by seg "
                        "union all select 'priority', priority, count(*) from enc where priority is not null group by priority), "
                        "r as (select f, v, row_number() over (partition by f order by n desc, v) rn from c) "
                        "select f as feature, v as mode from r where rn = 1")
    q["one_hot"] = ("with " + ENC_CLEAN + """ select id, "seg_BUILDING", "seg_FURNITURE", "seg_HOUSEHOLD",
        "seg_MACHINERY", "priority_2-HIGH", "priority_3-MEDIUM", "priority_4-NOT SPECIFIED", "priority_5-LOW" from coded""")
    q["clean_nan"] = ("with " + ENC_CLEAN + " select id, round(acctbal, 6) acctbal, round(price, 6) price, "
                      + ", ".join(f'"{c}"' for c in CODED_COLS[2:]) + ", y from coded")
    q["clean"] = ("with " + ENC_CLEAN + " select id, round(acctbal, 6) acctbal, round(price, 6) price, "
                  + ", ".join(f'"{c}"' for c in CODED_COLS[2:]) + ", y from coded")
    q["split_hash"] = f"with {ENC} select id, y, {SPLIT} as split from enc"
    q["split_exact"] = (f"with {ENC}, r as (select id, y, row_number() over (partition by y order by "
                        "md5(cast(id as varchar) || ':42'), id) rn, count(*) over (partition by y) n from enc) "
                        "select id, y, case when rn <= ceil(0.2*n) then 'test' when rn <= ceil(0.2*n) + ceil(0.1*n) "
                        "then 'val' else 'train' end as split from r")
    q["split_balance"] = (f"with {ENC} select split, count(*) as n, round(avg(y), 6) as positive_rate from "
                          f"(select y, {SPLIT} as split from enc) group by split")
    q["scale_params"] = ("with " + ENC_CLEAN + f", sp as (select *, {SPLIT} as split from coded), params as ("
                         + _params_sql() + ") select feature, round(mean, 6) mean, round(std, 6) std from params")
    q["standardize"] = _standardize_sql()
    q["anova_f"] = (f"with {TOXIC}, " + _anova_sql("toxic", TOXIC_NUM, "toxic")
                    + " select feature, idx, round(f_score, 6) f_score from scores")
    q["anova_f_lineitem"] = ("with li as (select *, cast(l_returnflag = 'R' as int) y from lineitem), "
                             + _anova_sql("li", LINE_FEATURES, "y")
                             + " select feature, idx, round(f_score, 6) f_score from scores")
    li = "with li as (select *, cast(l_returnflag = 'R' as int) y from lineitem), "
    shifted = "lm as (select l_quantity + 1e9 as l_quantity, l_extendedprice + 1e9 as l_extendedprice, y from li), "
    q["anova_f_shifted"] = (li + shifted + _anova_sql("li", ["l_quantity", "l_extendedprice"], "y")
                            + " select feature, idx, round(f_score, 2) f_score from scores").replace(shifted, "")
    q["top_k_perfect"] = ("select 'l_quantity' as feature, cast(2 as int) as rank, true as has_f, false as infinite union all "
                          "select 'perfect', 1, true, true union all select 'same', 3, false, false")
    q["top_k_features"] = (f"with {TOXIC}, " + _anova_sql("toxic", TOXIC_NUM, "toxic")
                           + ", r as (select *, cast(row_number() over (order by f_score desc nulls last, idx desc) as int) as rank from scores) "
                           "select feature, idx, round(f_score, 6) f_score, rank from r where rank <= 3")


SCORED_DOCS = TOXIC + """,
scored as (
  select 'punct' as model, doc_id, quality as label, cast(punct_ratio < 0.1 as int) as prediction, -punct_ratio as score from toxic
  union all select 'length', doc_id, quality, cast(words > 300 as int), cast(words as double) from toxic
  union all select 'digits', doc_id, quality, cast(digit_ratio > 0.001 as int), digit_ratio from toxic)"""

SCORED_ENC = ENC + """,
scored as (
  select 'price' as model, id, y as label, cast(price > 250000.0 as int) as prediction, price as score from enc
  union all select 'acctbal', id, y, cast(coalesce(acctbal, 0.0) > 4500.0 as int), coalesce(acctbal, 0.0) from enc)"""

CONF = """conf as (select model,
  cast(sum(case when label = 0 and prediction = 0 then 1 else 0 end) as bigint) tn,
  cast(sum(case when label = 0 and prediction = 1 then 1 else 0 end) as bigint) fp,
  cast(sum(case when label = 1 and prediction = 0 then 1 else 0 end) as bigint) fn,
  cast(sum(case when label = 1 and prediction = 1 then 1 else 0 end) as bigint) tp from scored group by model)"""

CURVE = """g as (select model, score, sum(label) p, count(*) - sum(label) n from scored where score is not null group by model, score),
c as (select model, score, p, n,
  sum(p) over (partition by model order by score desc rows between unbounded preceding and current row) cp,
  sum(n) over (partition by model order by score desc rows between unbounded preceding and current row) cn,
  row_number() over (partition by model order by score desc) idx,
  count(*) over (partition by model) m,
  sum(p) over (partition by model) tp_all, sum(n) over (partition by model) tn_all from g)"""


def _sd(x: str, y: str) -> str:
    return f"(case when ({y}) = 0 then 0.0 else ({x}) * 1.0 / ({y}) end)"


def _more_sql(q: dict[str, str]) -> None:
    q["class_balance"] = (f"with {ENC}, c as (select y, count(*) n from enc group by y) "
                          "select y, n, round(n * 1.0 / sum(n) over (), 6) share from c")
    q["positive_rate"] = f"with {TOXIC} select round(avg(cast(toxic as double)), 6) positive_rate from toxic"
    cols = TOXIC_NUM + ["quality"]
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1:]]
    q["corr_matrix"] = (f"with {TOXIC} " + " union all ".join(
        f"select '{a}' a, '{b}' b, round(corr(cast({a} as double), cast({b} as double)), 6) as corr from toxic"
        for a, b in pairs))
    q["class_kde"] = (f"with {TOXIC}, d as (select quality label, punct_ratio x from toxic where punct_ratio is not null), "
                      "st as (select label, count(*) n, stddev_samp(x) sd, min(x) lo, max(x) hi from d group by label), "
                      "st2 as (select *, sd * pow(cast(n as double), -0.2) h from st), "
                      "v as (select label, x, count(*) c from d group by label, x), "
                      "gr as (select unnest(range(0, 200)) g), "
                      "j as (select v.label, v.x, v.c, st2.n, st2.h, st2.lo, st2.hi, gr.g, "
                      "  (st2.lo - 3.0 * st2.h) + gr.g * ((st2.hi - st2.lo + 2 * 3.0 * st2.h) / 199.0) gx "
                      "  from v join st2 on v.label = st2.label cross join gr) "
                      "select label, cast(g as int) g, round(min(gx), 6) grid_x, "
                      "round(sum(c * exp(-0.5 * pow((gx - x) / h, 2)) / (n * h * sqrt(2 * pi()))), 6) density "
                      "from j group by label, g")
    q["confusion"] = f"with {SCORED_DOCS}, {CONF} select * from conf"
    bal = (f"case when tp + fn > 0 and tn + fp > 0 then ({_sd('tp', 'tp + fn')} + {_sd('tn', 'tn + fp')}) / 2 "
           f"when tp + fn > 0 then {_sd('tp', 'tp + fn')} else {_sd('tn', 'tn + fp')} end")
    q["binary_metrics"] = (f"with {SCORED_DOCS}, {CONF}, {CURVE}, "
                           "auc as (select model, sum(p * (cn2 - n * 0.5)) / (cast(sum(p) as double) * sum(n)) v, sum(p) pp, sum(n) nn from "
                           "(select model, p, n, sum(n) over (partition by model order by score rows between unbounded preceding and current row) cn2 from g) group by model), "
                           "ap as (select model, sum(p * cp / (cp + cn)) / sum(p) v, sum(p) pp, sum(n) nn from c group by model) "
                           f"select model, 'accuracy' metric, round({_sd('tp + tn', 'tp + tn + fp + fn')}, 6) value from conf "
                           f"union all select model, 'balanced_accuracy', round({bal}, 6) from conf "
                           f"union all select model, 'precision', round({_sd('tp', 'tp + fp')}, 6) from conf "
                           f"union all select model, 'recall', round({_sd('tp', 'tp + fn')}, 6) from conf "
                           f"union all select model, 'f1', round({_sd('2 * tp', '2 * tp + fp + fn')}, 6) from conf "
                           "union all select model, 'roc_auc', round(v, 6) from auc where pp > 0 and nn > 0 "
                           "union all select model, 'pr_auc', round(v, 6) from ap where pp > 0 and nn > 0")
    q["roc_auc"] = (f"with {SCORED_ENC}, g as (select model, score, sum(label) p, count(*) - sum(label) n from scored "
                    "where score is not null group by model, score), "
                    "w as (select model, p, n, sum(n) over (partition by model order by score rows between unbounded preceding and current row) cn from g) "
                    "select model, round(sum(p * (cn - n * 0.5)) / (cast(sum(p) as double) * sum(n)), 6) roc_auc from w "
                    "group by model having sum(p) > 0 and sum(n) > 0")
    q["average_precision"] = (f"with {SCORED_ENC}, {CURVE} select model, round(sum(p * cp / (cp + cn)) / sum(p), 6) pr_auc "
                              "from c group by model having sum(p) > 0 and sum(n) > 0")
    q["roc_curve"] = (f"with {SCORED_ENC}, {CURVE}, "
                      "d as (select *, lag(cp) over w cpp, lead(cp) over w cpn, lag(cn) over w cnp, lead(cn) over w cnn "
                      "from c window w as (partition by model order by idx)) "
                      "select model, round(cast(score as double), 6) threshold, round(cn / tn_all, 6) fpr, round(cp / tp_all, 6) tpr "
                      "from d where tp_all > 0 and tn_all > 0 and (idx = 1 or idx = m or cpp - 2 * cp + cpn != 0 or cnp - 2 * cn + cnn != 0) "
                      "union all select distinct model, cast(null as double), 0.0, 0.0 from c where tp_all > 0 and tn_all > 0")
    q["pr_curve"] = (f"with {SCORED_ENC}, {CURVE} "
                     "select model, round(cast(score as double), 6) threshold, round(cp / (cp + cn), 6) \"precision\", round(cp / tp_all, 6) recall "
                     "from c where tp_all > 0 and tn_all > 0 "
                     "union all select distinct model, cast(null as double), 1.0, 0.0 from c where tp_all > 0 and tn_all > 0")



VEC = "v as (select vec_id, cast(embedding as double[]) emb, label % 2 as cls from embeddings)"
RBF = "exp(-0.1 * pow(list_distance(a.emb, b.emb), 2))"
LM = "lm as (select * from v order by md5(cast(vec_id as varchar) || ':42'), vec_id limit {n})"

# the three dimensions with the best F (by deviations), standardised, in order of dimension
BEST3 = VEC + """,
u as (select vec_id, cls, unnest(emb) as x, generate_subscripts(emb, 1) as i from v),
d as (select *, avg(x) over (partition by i, cls) as m, avg(x) over (partition by i) as g from u),
f as (select i, (sum((m - g) * (m - g)) / (count(distinct cls) - 1)) / (sum((x - m) * (x - m)) / (count(*) - count(distinct cls))) as score
      from d group by i),
best as (select i, row_number() over (order by i) as r from (select i from f order by score desc, i desc limit 3)),
z as (select vec_id, cls, r, (x - avg(x) over (partition by i)) / (case when stddev_pop(x) over (partition by i) = 0 then 1
      else stddev_pop(x) over (partition by i) end) as x from u join best using (i)),
s as (select vec_id, any_value(cls) cls, max(x) filter (r = 1) a, max(x) filter (r = 2) b, max(x) filter (r = 3) c from z group by vec_id)"""
_TRIG = "[sqrt(0.5), cos(2 * {0}) * sqrt(0.5), sin(2 * {0}) * sqrt(0.5)]"


def _fourier(draw: str, places: int) -> str:
    """fx: (vec_id, cls, i, x) of the drawn features; ``draw`` is the SQL of a
    frequency."""
    return f"""{VEC},
dims as (select distinct generate_subscripts(emb, 1) - 1 as i from v),
draws as (select j, i, cast({draw} as double) as w from range({places}) t(j), dims),
ws as (select j, list(w order by i) as w from draws group by j),
angles as (select vec_id, cls, j, list_inner_product(emb, w) as a from v, ws),
fx as (select vec_id, cls, cast(2 * j + s as int) as i, (case s when 0 then cos(a) else sin(a) end) / sqrt({places}) as x
       from angles, range(2) r(s))"""


def _fourier_sql(q: dict[str, str]) -> None:
    u = "(('0x' || substr(md5(cast(j as varchar) || ':' || cast(i as varchar) || ':42:{}'), 1, 13))::BIGINT / 4503599627370496.0)"
    normal = f"sqrt(0.2) * sqrt(-2 * ln(1 - {u.format('radius')})) * cos(2 * pi() * {u.format('angle')})"
    line = u.format("line")
    cos2 = f"case when {line} < 0.5 then 0 when {line} < 0.75 then 2 else -2 end"
    for name, draw in (("rbf", normal), ("cos2", cos2)):
        q[f"{name}_fourier_features"] = f"with {_fourier(draw, 16)} select vec_id, i, round(x, 6) as x from fx"
    q["rbf_fourier_blocks"] = (f"with {_fourier(normal, 256)}, s as (select cls, i, sum(x) as s, count(*) as n from fx group by cls, i) "
                               "select a.cls as label_i, b.cls as label_j, round(sum(a.s * b.s) / (max(a.n) * max(b.n)), 6) as mean_k "
                               "from s a join s b using (i) group by a.cls, b.cls")


def _kernel_sql(q: dict[str, str]) -> None:
    for name, cte, src, k in (("", VEC, "v", "list_inner_product(a.emb, b.emb)"),
                              ("cos2_", BEST3, "s", "pow(cos(a.a - b.a), 2) * pow(cos(a.b - b.b), 2) * pow(cos(a.c - b.c), 2)")):
        q[f"{name}kernel_stats"] = (f"with {cte}, p as (select a.vec_id i, b.vec_id j, {k} k from {src} a cross join {src} b) "
                                    "select cast(sum(case when i = j then 1 else 0 end) as bigint) n, "
                                    "round(sum(case when i != j then k else 0 end) / count(*), 6) offdiag_mean, "
                                    "round(avg(case when i = j then k end), 6) diag_mean from p")
        q[f"{name}kernel_blocks"] = (f"with {cte} select a.cls label_i, b.cls label_j, round(avg({k}), 6) mean_k "
                                     f"from {src} a cross join {src} b group by a.cls, b.cls")
    cos2 = "pow(cos(a.a - b.a), 2) * pow(cos(a.b - b.b), 2) * pow(cos(a.c - b.c), 2)"
    q["cos2_spectrum"] = (f"with {BEST3}, p as (select a.vec_id i, b.vec_id j, {cos2} k from s a cross join s b) "
                          "select count(*) filter (i = j) n, round(sum(k) filter (i = j), 6) trace, round(sum(k * k), 6) frobenius2 from p")
    entry = " * ".join(f"{_TRIG.format('s.' + c)}[1 + (i // {p}) % 3]" for c, p in (("a", 9), ("b", 3), ("c", 1)))
    q["cos2_features"] = f"with {BEST3} select vec_id, cast(i as int) i, round({entry}, 6) x from s, range(27) t(i)"
    q["cross_gram"] = (f"with {VEC} select a.vec_id i, b.vec_id j, round({RBF}, 6) k "
                       "from v a cross join v b where b.vec_id % 20 = 0")
    q["cross_gram_cos2"] = f"with {BEST3} select a.vec_id i, b.vec_id j, round({cos2}, 6) k from s a cross join s b where b.vec_id % 20 = 0"
    q["kernel_sorted"] = (f"with {VEC}, {LM.format(n=60)}, s as (select *, cast(row_number() over (order by cls, vec_id) - 1 as int) pos from lm) "
                          f"select a.pos pos_i, b.pos pos_j, round({RBF}, 6) k from s a cross join s b")
    q["platt_gradient"] = "select cast(0 as bigint) as missing, 0.0::double as slope, 0.0::double as intercept"
    q["logreg_gradient"] = (f"with {TOXIC}, l as (select distinct lang from toxic) "
                            "select unnest(['(intercept)', 'n_chars', 'words', 'digit_ratio', 'punct_ratio', 'lines']) as feature, 0.0::double as gradient "
                            "union all select 'lang_' || lang, 0.0::double from l where lang > (select min(lang) from l)")


def _metrics_cte(src: str, name: str) -> str:
    """Metrics (model, metric, value) of a scored CTE ``src``, unrounded."""
    return f"""{name}_conf as (select model,
  sum(case when label = 0 and prediction = 0 then 1 else 0 end) tn,
  sum(case when label = 0 and prediction = 1 then 1 else 0 end) fp,
  sum(case when label = 1 and prediction = 0 then 1 else 0 end) fn,
  sum(case when label = 1 and prediction = 1 then 1 else 0 end) tp from {src} group by model),
{name}_g as (select model, score, sum(label) p, count(*) - sum(label) n from {src} where score is not null group by model, score),
{name}_c as (select model, p, n,
  sum(p) over (partition by model order by score desc rows between unbounded preceding and current row) cp,
  sum(n) over (partition by model order by score desc rows between unbounded preceding and current row) cn,
  sum(n) over (partition by model order by score rows between unbounded preceding and current row) cna from {name}_g),
{name}_m as (
  select model, 'accuracy' metric, {_sd('tp + tn', 'tp + tn + fp + fn')} value from {name}_conf
  union all select model, 'balanced_accuracy', case when tp + fn > 0 and tn + fp > 0 then ({_sd('tp', 'tp + fn')} + {_sd('tn', 'tn + fp')}) / 2
     when tp + fn > 0 then {_sd('tp', 'tp + fn')} else {_sd('tn', 'tn + fp')} end from {name}_conf
  union all select model, 'precision', {_sd('tp', 'tp + fp')} from {name}_conf
  union all select model, 'recall', {_sd('tp', 'tp + fn')} from {name}_conf
  union all select model, 'f1', {_sd('2 * tp', '2 * tp + fp + fn')} from {name}_conf
  union all select model, 'roc_auc', sum(p * (cna - n * 0.5)) / (cast(sum(p) as double) * sum(n)) from {name}_c
     group by model having sum(p) > 0 and sum(n) > 0
  union all select model, 'pr_auc', sum(p * cp / (cp + cn)) / sum(p) from {name}_c
     group by model having sum(p) > 0 and sum(n) > 0)"""


RESULTS = (TOXIC + ", " + ENC + """,
sd as (
  select 'punct' as model, doc_id, quality as label, cast(punct_ratio < 0.1 as int) as prediction, -punct_ratio as score from toxic
  union all select 'length', doc_id, quality, cast(words > 300 as int), cast(words as double) from toxic
  union all select 'digits', doc_id, quality, cast(digit_ratio > 0.001 as int), digit_ratio from toxic),
st as (select sd.model, sd.doc_id, t.toxic as label, sd.prediction, sd.score from sd join toxic t on sd.doc_id = t.doc_id),
se as (
  select 'price' as model, id, y as label, cast(price > 250000.0 as int) as prediction, price as score from enc
  union all select 'acctbal', id, y, cast(coalesce(acctbal, 0.0) > 4500.0 as int), coalesce(acctbal, 0.0) from enc),
""" + _metrics_cte("sd", "sd") + ",\n" + _metrics_cte("se", "se") + ",\n" + _metrics_cte("st", "st") + """,
res as (select 'classical' block, model, metric, value from sd_m
  union all select 'qsvm', model, metric, value from se_m
  union all select 'bonus', model, metric, value from st_m),
rk as (select *, case block when 'classical' then 1 when 'qsvm' then 2 when 'bonus' then 3 else 4 end r from res),
flat as (select model, metric, value from rk where (r, block) = (select max((r2.r, r2.block)) from rk r2 where r2.model = rk.model)),
auc as (select m.model, coalesce(a.value, 0.0) v from (select distinct model from flat) m
  left join (select model, value from flat where metric = 'roc_auc') a on m.model = a.model),
ranked as (select model, v as roc_auc, cast(row_number() over (order by v desc, model) as int) as rank from auc)""")

PIVOT_METRICS = ["accuracy", "balanced_accuracy", "precision", "recall", "f1", "roc_auc", "pr_auc"]


def _fmt(x: str, d: int) -> str:
    p = 10 ** d
    sc = f"cast(floor(abs({x}) * {p} + 0.5) as bigint)"
    return (f"(case when {x} is null or isnan({x}) then 'nan' else (case when {x} < 0 then '-' else '' end) "
            f"|| cast({sc} // {p} as varchar) || '.' || lpad(cast({sc} % {p} as varchar), {d}, '0') end)")


def _results_sql(q: dict[str, str]) -> None:
    q["upsert_results"] = (f"with {RESULTS} select block, model, metric, round(value, 6) as value from res "
                           "where block = 'qsvm' or (block = 'classical' and model = 'punct')")
    q["results_store"] = q["upsert_results"]
    q["flatten_results"] = f"with {RESULTS} select model, metric, round(value, 6) value from flat"
    q["model_ranking"] = f"with {RESULTS} select model, round(roc_auc, 6) roc_auc, rank from ranked"
    piv = ", ".join(f"round(max(case when metric = '{m}' then value end), 6) as {m}" for m in PIVOT_METRICS + ["train_seconds"])
    q["results_json"] = (f"with {RESULTS}, pm as (select block, model, string_agg('\"' || metric || '\":' || cast(round(value, 6) as varchar), ',' order by metric) as m "
                         "from res group by block, model) select block, '{' || string_agg('\"' || model || '\":{' || m || '}', ',' order by model) || '}' as json "
                         "from pm group by block")
    q["metric_pivot"] = f"with {RESULTS} select model, {piv} from flat group by model"
    q["metric_bars"] = f"with {RESULTS} select model, round(value, 6) value from flat where metric = 'roc_auc'"
    cells = " || ' | ' || ".join(
        ["r.model"] + [_fmt(f"w.{m}", 3) for m in PIVOT_METRICS] + [_fmt("w.train_seconds", 2)])
    wide = ", ".join(f"round(max(case when metric = '{m}' then value end), 6) as {m}"
                     for m in PIVOT_METRICS + ["train_seconds"])
    q["readme_table"] = (f"with {RESULTS}, w as (select model, {wide} from flat group by model) "
                         f"select r.rank, '| ' || {cells} || ' |' as line from ranked r left join w on r.model = w.model")



def _u(key: str, purpose: str) -> str:
    return (f"(('0x' || substr(md5(cast({key} as varchar) || ':42:{purpose}'), 1, 13))::BIGINT "
            "/ 4503599627370496.0)")


def _normal(key: str, purpose: str, mean: float, sd: float) -> str:
    return (f"({mean!r} + {sd!r} * (sqrt(-2.0 * ln(1.0 - {_u(key, purpose + ':a')})) "
            f"* cos(6.283185307179586 * {_u(key, purpose + ':b')})))")


def _synthetic_sql(rounded: bool = True) -> str:
    from calibra.sources import synthetic as S
    k = "o_orderkey"
    sel = [f"{k} as encounter_id", f"{k} as patient_id"]
    for name, kind, par, (lo, hi) in S.CONTINUOUS:
        if kind == "exp":
            raw = f"(-{par[0]!r} * ln(1.0 - {_u(k, name)}))"
        else:
            raw = _normal(k, name, float(par[0]), float(par[1]))
            if kind == "absnormal":
                raw = f"abs({raw})"
        sel.append(f"greatest({float(lo)!r}, least({raw}, {float(hi)!r})) as {name}")
    for name, values, probs in S.CHOICES:
        acc, parts = 0.0, []
        for v, p in zip(values[:-1], probs[:-1]):
            acc += p
            lit = f"'{v}'" if isinstance(v, str) else str(v)
            parts.append(f"when {_u(k, name)} < {acc!r} then {lit}")
        last = f"'{values[-1]}'" if isinstance(values[-1], str) else str(values[-1])
        sel.append(f"case {' '.join(parts)} else {last} end as {name}")
    sev = " + ".join(
        (f"abs({n} - {c!r}) * {w!r}" if n == "temp_apache" else f"({n} - {c!r}) * {w!r}")
        for n, w, c in S.SEVERITY)
    e = "encounter_id"
    score = (f"greatest({S.SCORE_CLIP[0]!r}, least(1.0 / (1.0 + exp(-(sev - {S.SCORE_OFFSET!r}))) + "
             f"{_normal(e, 'score_noise', 0.0, S.SCORE_NOISE)}, {S.SCORE_CLIP[1]!r}))")
    pdeath = f"1.0 / (1.0 + exp(-(sev - {S.LABEL_OFFSET!r} + {_normal(e, 'label_noise', 0.0, S.LABEL_NOISE)})))"
    miss = {c: f"case when {_u(e, 'missing:' + c)} < {S.MISSING_RATE!r} then null else {{v}} end"
            for c in S.MISSING_COLUMNS}
    cols = (["encounter_id", "patient_id"] + [c[0] for c in S.CONTINUOUS]
            + ["gcs_eyes_apache", "gcs_motor_apache", "gcs_verbal_apache",
               "apache_4a_hospital_death_prob", "gender", "ethnicity", "icu_type",
               "elective_surgery", "hospital_death"])
    final = []
    for c in cols:
        v = c
        if c in miss:
            v = miss[c].format(v=c)
        if rounded and (c in [x[0] for x in S.CONTINUOUS] or c == "apache_4a_hospital_death_prob"):
            v = f"round({v}, 6)"
        final.append(f"{v} as {c}")
    return (f"with b as (select {', '.join(sel)} from orders), "
            f"s as (select *, {sev} as sev from b), "
            f"l as (select *, {score} as apache_4a_hospital_death_prob, "
            f"cast({_u(e, 'label')} < {pdeath} as int) as hospital_death from s) "
            f"select {', '.join(final)} from l")


def _select_top_k_sql() -> str:
    """The two columns with the best F on the training rows, of the test rows."""
    long = " union all ".join(f"""select id, split, y, '{c}' as f, {i} as idx, cast("{c}" as double) as x from sp"""
                              for i, c in enumerate(CODED_COLS))
    return ("with " + ENC_CLEAN + f""", sp as materialized (select *, {SPLIT} as split from coded), u as materialized ({long}),
g as materialized (select f, avg(x) as g from u where split = 'train' group by f),
m as materialized (select u.f, y, idx, count(*) as n, avg(x) as m, var_pop(x) * count(*) as ss from u where split = 'train' group by u.f, y, idx),
b as materialized (select f, idx, (sum(n * (m - g) * (m - g)) / (count(*) - 1)) / (sum(ss) / (sum(n) - count(*))) as s
      from m join g using (f) group by f, idx order by s desc, idx desc limit 2)
select id, u.f as feature, round(x, 6) as x from u join b using (f) where split = 'test'""")


#: Line items with slots: numbers first, then the values of each string column
#: but its first, in order; missing values are the most frequent one.
_LINES = """lines as materialized (select l_orderkey, l_linenumber, l_quantity, l_discount, cast(l_returnflag = 'R' as int) as y,
  case when l_linenumber <> 7 then 'P' || cast(l_partkey as varchar) end as part, l_linestatus as status from lineitem),
fills as (select (select part from lines where part is not null group by part order by count(*) desc, part limit 1) as part,
  (select status from lines where status is not null group by status order by count(*) desc, status limit 1) as status),
parts as materialized (select part, row_number() over (order by part) - 1 as i from (select distinct part from lines where part is not null)),
stats as materialized (select status, row_number() over (order by status) - 1 as i from (select distinct status from lines where status is not null)),
entries as materialized (
  select l_orderkey, l_linenumber, y, cast(0 as bigint) as slot, l_quantity as x from lines where l_quantity <> 0
  union all select l_orderkey, l_linenumber, y, cast(1 as bigint), l_discount from lines where l_discount <> 0
  union all select l_orderkey, l_linenumber, y, cast(1 + p.i as bigint), 1.0 from lines as l, fills as f, parts as p where p.part = coalesce(l.part, f.part) and p.i > 0
  union all select l_orderkey, l_linenumber, y, cast(1 + (select max(i) from parts) + s.i as bigint), 1.0 from lines as l, fills as f, stats as s
    where s.status = coalesce(l.status, f.status) and s.i > 0),
slots as (select cast(unnest(range(2 + (select max(i) from parts) + (select max(i) from stats))) as bigint) as slot)"""


def _sparse_sql(q: dict[str, str]) -> None:
    q["sparse_entries"] = f"with {_LINES} select l_orderkey, l_linenumber, slot, round(x, 6) as x from entries"
    q["sparse_moments"] = (f"with {_LINES}, n as (select count(*) as n from lines), s as (select slot, sum(x) / any_value(n.n) as m, sum(x * x) / any_value(n.n) as q from entries, n group by slot) "
                           "select slot, round(coalesce(m, 0), 5) as mean, round(coalesce(sqrt(greatest(q - m * m, 0)), 0), 5) as std from slots left join s using (slot)")
    # two classes: between and within from the moments of each class, zeros among them
    q["sparse_f_scores"] = (f"with {_LINES}, c as (select y, count(*) as n from lines group by y), used as (select distinct slot from entries), "
                            "s as (select slot, y, sum(x) as s, sum(x * x) as q from entries group by slot, y), "
                            "t as (select u.slot, c.y, c.n, coalesce(s.s, 0) as s, coalesce(s.q, 0) as q from used as u cross join c left join s on s.slot = u.slot and s.y = c.y), "
                            "f as (select slot, sum(n) as n, count(*) as k, sum(s * s / n) - sum(s) * sum(s) / sum(n) as b, sum(q - s * s / n) as w from t group by slot) "
                            "select slot, case when w > 1e-12 * (b + w) then round((b / (k - 1)) / (w / (n - k)), 6) when b > 0 then cast('infinity' as double) end as f_score from f")


def _misc_sql(q: dict[str, str]) -> None:
    _sparse_sql(q)
    q["synthetic_table"] = _synthetic_sql()
    q["synthetic_label"] = (f"with t as ({_synthetic_sql()}) "
                            "select hospital_death, count(*) as n from t group by hospital_death")
    q["csv_roundtrip"] = q["curated_projection"].replace(
        "select id, acctbal, price, seg, priority, y from enc", "select * from enc")
    q["prepared_roundtrip"] = q["standardize"]
    q["streaming_standardize"] = q["standardize"]
    q["gather_rows"] = (f"with {ENC} select l_orderkey, l_linenumber, l_quantity from lineitem "
                        f"where l_orderkey in (select id from enc where {SPLIT} = 'test')")
    q["gather_rows_bucketed"] = q["gather_rows"]
    q["source_fallback"] = "select c_custkey, c_mktsegment, c_acctbal from customer"
    # 1000 // 4 rows, half of them positive
    q["kernel_test_sample"] = (f"with {ENC}, t as (select id, y from enc where {SPLIT} = 'test'), "
                               "r as (select id, y, row_number() over (partition by y order by md5(cast(id as varchar) || ':43'), id) rn, "
                               "count(*) over () nt, count(*) filter (y = 1) over () np from t) "
                               "select id, y from r where nt <= 250 or (y = 1 and rn <= least(125, np)) or (y = 0 and rn <= 250 - least(125, np))")
    q["balanced_subsample"] = (f"with {TOXIC}, c as (select count(*) filter (where toxic = 1) np, count(*) nt from toxic), "
                               "r as (select doc_id, toxic, row_number() over (partition by toxic order by "
                               "md5(cast(doc_id as varchar) || ':42'), doc_id) rn from toxic), "
                               "q as (select least(50, np) a, nt from c) "
                               "select doc_id, toxic from r, q where "
                               "(q.nt <= 100) or (toxic = 1 and rn <= q.a) or (toxic = 0 and rn <= 100 - q.a)")
    q["large_subsample"] = ("with o as (select o_orderkey as id, cast(o_orderstatus = 'F' as int) as y, row_number() over "
                            "(order by md5(cast(o_orderkey as varchar) || ':42'), o_orderkey) rn, count(*) over () n from orders) "
                            "select id, y from o where rn <= 2 * n // 3")
    one = SCORED_DOCS.replace("scored as (", "every as (") + ", scored as (select * from every where label = 1)"
    q["one_class_metrics"] = (f"with {one}, {_metrics_cte('scored', 'oc')} select model, metric, round(value, 6) as value from oc_m")
    u = _u("encounter_id", "elective_surgery")
    q["impute_binary"] = (f"with t as ({_synthetic_sql(rounded=False)}), b as (select encounter_id, case when {u} < 0.1 then null else elective_surgery end e from t) "
                          "select encounter_id, cast(coalesce(e, (select median(e) from b)) as double) as elective_surgery from b")
    q["select_top_k"] = _select_top_k_sql()
    q["uniform_subsample"] = (f"with {TOXIC} select doc_id, toxic from toxic "
                              "order by md5(cast(doc_id as varchar) || ':42'), doc_id limit 100")
    q["table_shape"] = f"with {ENC} select count(*) as n_rows, 6 as n_cols from enc"
    q["confusion_table"] = (f"with {SCORED_DOCS}, {CONF} "
                            "select model, 'Survived' actual, 'Survived' predicted, tn n from conf "
                            "union all select model, 'Survived', 'Died', fp from conf "
                            "union all select model, 'Died', 'Survived', fn from conf "
                            "union all select model, 'Died', 'Died', tp from conf")



def _synthetic_prepared_sql() -> str:
    from calibra.sources import synthetic as S
    num = list(S.NUMERIC_FEATURES) + ["elective_surgery"]
    med = ", ".join(f"median({c}) as m_{c}" for c in num)
    filled = ", ".join(f"coalesce({c}, (select m_{c} from med)) as {c}" for c in num)
    dummies = []
    for col, values, _ in S.CHOICES:
        if col in ("gender", "ethnicity", "icu_type"):
            for v in sorted(values)[1:]:
                dummies.append((f"{col}_{v}", f"cast({col} = '{v}' as int)"))
    coded = ", ".join([f"cast({c} as double) as {c}" for c in num]
                      + [f'{e} as "{n}"' for n, e in dummies])
    feats = num + [n for n, _ in dummies]
    params = " union all ".join(
        f"""select '{f}' as feature, avg(cast("{f}" as double)) as mean, stddev_pop(cast("{f}" as double)) as std
            from coded where split = 'train'""" for f in feats)
    sel = ", ".join(
        f"""round((cast(c."{f}" as double) - (select mean from params where feature = '{f}'))
            / (select case when std = 0 then 1.0 else std end from params where feature = '{f}'), 6) as "{f}" """
        for f in feats)
    split = SPLIT.replace("cast(id as varchar)", "cast(encounter_id as varchar)")
    return (f"with syn as ({_synthetic_sql(rounded=False)}), med as (select {med} from syn), "
            f"cl as (select encounter_id, hospital_death, gender, ethnicity, icu_type, {filled} from syn), "
            f"coded as (select encounter_id, {split} as split, cast(hospital_death as int) as label, {coded} from cl), "
            f"params as ({params}) "
            f"select c.encounter_id, c.split, c.label, {sel} from coded c")


def oracle_sql() -> dict[str, str]:
    """All oracle queries by name."""
    q: dict[str, str] = {}
    for section in (_prepare_sql, _more_sql, _kernel_sql, _fourier_sql, _results_sql, _misc_sql):
        section(q)
    q["synthetic_prepared"] = _synthetic_prepared_sql()
    return q
