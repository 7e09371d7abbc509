"""DuckDB SQL that gives the same rows as the registered queries."""

from __future__ import annotations

from tastegrid.plans.queries import ALLOWED, ALPHA, DENIED, DIGITS, FACTORS, K, N, RATE, REG

CP = """cp AS (SELECT o_custkey::BIGINT AS user_id, l_partkey::BIGINT AS item_id, sum(l_quantity)::DOUBLE AS weight
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2),
nu AS (SELECT count(*)::DOUBLE AS n FROM customer), ni AS (SELECT count(*)::DOUBLE AS n FROM part)"""
EV = """ev AS (SELECT user_id::BIGINT AS user_id, json_extract(props, '$.k')::BIGINT AS item_id, count(*)::DOUBLE AS weight
  FROM events WHERE json_extract(props, '$.k') IS NOT NULL AND user_id IS NOT NULL GROUP BY 1, 2)"""


def uniform(seed: int, *keys: str) -> str:
    """The seeded hash in [0, 1)."""
    return f"(('0x' || substr(md5(concat_ws(':', '{seed}', {', '.join(keys)})), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"


def factors(name: str, table: str, column: str, k: int, seed: int) -> str:
    cells = ", ".join(f"({uniform(seed, 'id', str(d))} - 0.5::DOUBLE)::FLOAT::DOUBLE" for d in range(k))
    return f"{name} AS (SELECT id, [{cells}] AS f FROM (SELECT {column}::BIGINT AS id FROM {table}))"


def users(k: int) -> str:
    return factors("u", "customer", "c_custkey", k, 11)


def items(k: int) -> str:
    return factors("i", "part", "p_partkey", k, 13)


EMB = "e AS (SELECT vec_id::BIGINT AS id, list_transform(embedding, lambda v: v::DOUBLE) AS f, label FROM embeddings)"


def top(source: str, query: str, item: str, k: int) -> str:
    """The k best rows of each query."""
    return f"""(SELECT *, row_number() OVER (PARTITION BY {query} ORDER BY score DESC, {item} DESC) AS rank FROM {source}
  QUALIFY rank <= {k})"""


def listed(ids: tuple[int, ...] | range) -> str:
    return "(" + ", ".join(map(str, ids)) + ")"


TFIDF_ITEM = """tf AS (SELECT user_id, item_id, sqrt(weight) * (ln((SELECT n FROM ni)) - ln(1 + c)) AS weight
  FROM {x} JOIN (SELECT user_id, count(*)::DOUBLE AS c FROM {x} GROUP BY 1) USING (user_id)),
w AS (SELECT user_id, item_id, coalesce(weight / nullif(n, 0), 0) AS weight
  FROM tf JOIN (SELECT item_id, sqrt(sum(weight * weight)) AS n FROM tf GROUP BY 1) USING (item_id))"""
COSINE_W = """w AS (SELECT user_id, item_id, coalesce(weight / nullif(n, 0), 0) AS weight
  FROM cp JOIN (SELECT item_id, sqrt(sum(weight * weight)) AS n FROM cp GROUP BY 1) USING (item_id))"""


def bm25(row: str, col: str, n: str, k1: float, b: float) -> str:
    return f"""w AS (SELECT user_id, item_id, weight * ({k1 + 1}::DOUBLE)
   / ({k1}::DOUBLE * ({1 - b}::DOUBLE + {b}::DOUBLE * length / (SELECT sum(weight) / (SELECT n FROM {n}) FROM cp)) + weight)
   * (ln((SELECT n FROM {n})) - ln(1 + df)) AS weight
  FROM cp JOIN (SELECT {col}, count(*)::DOUBLE AS df FROM cp GROUP BY 1) USING ({col})
  JOIN (SELECT {row}, sum(weight) AS length FROM cp GROUP BY 1) USING ({row}))"""


def sim(w: str) -> str:
    return f"""pairs AS (SELECT a.item_id AS item, b.item_id AS neighbour, round(sum(a.weight * b.weight), {DIGITS}) AS score
  FROM {w} a JOIN {w} b USING (user_id) GROUP BY 1, 2),
sim AS (SELECT item, neighbour, score FROM {top('pairs', 'item', 'neighbour', K)})"""


SIM = "SELECT item, neighbour, score FROM sim"
BM25_SIM = f"{CP}, {bm25('item_id', 'user_id', 'ni', 1.2, 0.75)}, {sim('w')}"


def recommend(x: str, liked: bool = True, where: str = "") -> str:
    anti = f"WHERE NOT EXISTS (SELECT 1 FROM {x} l WHERE l.user_id = s.user_id AND l.item_id = s.item_id)" if liked else "WHERE true"
    return f"""scores AS (SELECT user_id, neighbour AS item_id, round(sum(weight * score), {DIGITS}) AS score
  FROM {x} JOIN sim ON item_id = item GROUP BY 1, 2),
open AS (SELECT * FROM scores s {anti} {where}),
recs AS (SELECT user_id, rank, item_id, score FROM {top('open', 'user_id', 'item_id', N)})"""


SPLIT7 = f"""{CP}, marked AS (SELECT *, count(*) OVER (PARTITION BY user_id) AS n,
  row_number() OVER (PARTITION BY user_id ORDER BY {uniform(7, 'user_id', 'item_id')}, item_id) AS k FROM cp)"""
CHOSEN7 = f"""chosen AS (SELECT user_id FROM (SELECT DISTINCT user_id FROM cp) ORDER BY {uniform(7, 'user_id')}, user_id
  LIMIT (SELECT greatest(1, floor(count(DISTINCT user_id) * 0.25::DOUBLE))::BIGINT FROM cp))"""
METRICS = f"""{SPLIT7}, train AS (SELECT user_id, item_id, weight FROM marked WHERE NOT (n > 4 AND k <= 3)),
test AS (SELECT user_id, item_id FROM marked WHERE n > 4 AND k <= 3),
{TFIDF_ITEM.format(x='train')}, {sim('w')}, {recommend('train')},
liked AS (SELECT user_id, count(*)::DOUBLE AS liked FROM test GROUP BY 1),
hits AS (SELECT r.user_id, r.rank, (t.item_id IS NOT NULL)::INT AS hit
  FROM recs r SEMI JOIN liked l USING (user_id) LEFT JOIN test t ON r.user_id = t.user_id AND r.item_id = t.item_id),
run AS (SELECT *, sum(hit) OVER (PARTITION BY user_id ORDER BY rank ROWS UNBOUNDED PRECEDING) AS found FROM hits),
each AS (SELECT user_id, sum(hit)::DOUBLE AS hits, sum(hit * found / rank::DOUBLE) AS ap, sum(hit / log2(rank + 1)) AS dcg,
  sum((1 - hit) * found)::DOUBLE AS passed, count(*) AS ranks FROM run GROUP BY 1),
m AS (SELECT liked, least({N}, liked) AS most, coalesce(hits, 0) AS hits, coalesce(ap, 0) AS ap, coalesce(dcg, 0) AS dcg,
  coalesce(passed, 0) AS passed, coalesce(ranks, 0) AS ranks, (SELECT n FROM ni) - liked AS neg FROM liked LEFT JOIN each USING (user_id))"""


def scored(queries: str, candidates: str, cosine: bool = False) -> str:
    score = "list_dot_product(q.f, c.f)"
    if cosine:
        norm = "CASE WHEN list_dot_product({0}.f, {0}.f) = 0 THEN 1e-10 ELSE sqrt(list_dot_product({0}.f, {0}.f)) END"
        score += f" / ({norm.format('q')}) / ({norm.format('c')})"
    return f"scored AS (SELECT q.id AS query_id, c.id, round({score}, {DIGITS}) AS score FROM {queries} q, {candidates} c)"


def mf(where: str = "true", k: int = FACTORS, n: int = N) -> str:
    return f"""WITH {CP}, {users(k)}, {items(k)}, {scored('u', 'i')},
open AS (SELECT query_id AS user_id, id AS item_id, score FROM scored s WHERE {where})
SELECT user_id, rank, item_id, score FROM {top('open', 'user_id', 'item_id', n)}"""


UNLIKED = "NOT EXISTS (SELECT 1 FROM cp l WHERE l.user_id = s.query_id AND l.item_id = s.id)"
#: Entries with two-dimensional item factors, scaled; the sums of the item factors' products.
ALS = f"""{CP}, {items(2)}, s AS (SELECT user_id, item_id, weight * {ALPHA}::DOUBLE AS c, f[1] AS y1, f[2] AS y2 FROM cp JOIN i ON item_id = id),
g AS (SELECT sum(f[1] * f[1]) AS g11, sum(f[1] * f[2]) AS g12, sum(f[2] * f[2]) AS g22 FROM i),
eq AS (SELECT user_id, any_value(g11) + {REG}::DOUBLE + sum((abs(c) - 1) * y1 * y1) AS a, any_value(g12) + sum((abs(c) - 1) * y1 * y2) AS b,
  any_value(g22) + {REG}::DOUBLE + sum((abs(c) - 1) * y2 * y2) AS d, sum(greatest(c, 0) * y1) AS p, sum(greatest(c, 0) * y2) AS q FROM s, g GROUP BY 1)"""
HALF_STEP = f"""WITH {ALS} SELECT user_id, round((d * p - b * q) / (a * d - b * b), {DIGITS}) AS x1, round((a * q - b * p) / (a * d - b * b), {DIGITS}) AS x2 FROM eq"""
CENTROIDS = """c AS (SELECT label, list(v ORDER BY pos) AS centroid FROM (
  SELECT label, pos, round(avg(f[pos]), 9) AS v FROM e, (SELECT unnest(range(1, 65)) AS pos) GROUP BY 1, 2) GROUP BY 1),
near AS (SELECT id, f, c.label AS cell, row_number() OVER (PARTITION BY id ORDER BY round(list_dot_product(f, centroid), 9) DESC, c.label DESC) AS p FROM e, c)"""

#: Entries with another item each, at two factors and a bias, and what a ranking step takes from each.
BPR = f"""{CP}, {users(2)}, {items(3)},
s AS (SELECT user_id, item_id, floor({uniform(3, 'user_id', 'item_id')} * (SELECT n FROM ni))::BIGINT AS other FROM cp),
t AS (SELECT user_id, item_id, other, [u.f[1], u.f[2], 1.0::DOUBLE] AS x, a.f AS y, b.f AS v FROM s JOIN u ON user_id = u.id JOIN i a ON item_id = a.id JOIN i b ON other = b.id),
z AS (SELECT *, 1 / (1 + exp(list_dot_product(x, y) - list_dot_product(x, v))) AS z FROM t)"""


def _bpr_users() -> str:
    sums = ", ".join(f"sum({RATE}::DOUBLE * (z * (y[{k}] - v[{k}]) - {REG}::DOUBLE * x[{k}])) AS d{k}" for k in (1, 2))
    cells = ", ".join(f"round(f[{k}] + coalesce(d{k}, 0), {DIGITS}) AS x{k}" for k in (1, 2))
    return f"WITH {BPR}, g AS (SELECT user_id, {sums} FROM z GROUP BY 1) SELECT u.id AS user_id, {cells}, 1.0::DOUBLE AS one FROM u LEFT JOIN g ON user_id = u.id"


def _bpr_items() -> str:
    def added(item: str, own: str, sign: str) -> str:
        return f"SELECT {item} AS id, " + ", ".join(f"{RATE}::DOUBLE * ({sign}z * x[{k}] - {REG}::DOUBLE * {own}[{k}]) AS d{k}" for k in (1, 2, 3)) + " FROM z"

    cells = ", ".join(f"round(f[{k}] + coalesce(d{k}, 0), {DIGITS}) AS {c}" for k, c in enumerate(("y1", "y2", "bias"), 1))
    sums = ", ".join(f"sum(d{k}) AS d{k}" for k in (1, 2, 3))
    return f"WITH {BPR}, a AS ({added('item_id', 'y', '')} UNION ALL {added('other', 'v', '-')}), g AS (SELECT id, {sums} FROM a GROUP BY 1) SELECT i.id AS item_id, {cells} FROM i LEFT JOIN g USING (id)"


def _lmf_step() -> str:
    sums = ", ".join(f"sum(w * y[{k}]) - {REG}::DOUBLE * any_value(x[{k}]) AS g{k}" for k in (1, 2, 4))
    cells = ", ".join(f"round(x[{k}] + {RATE}::DOUBLE / sqrt(1e-6::DOUBLE + g{k} * g{k}) * g{k}, {DIGITS}) AS {c}" for k, c in ((1, "x1"), (2, "x2"), (4, "bias")))
    return f"""WITH {CP}, {users(4)}, {items(4)},
s AS (SELECT user_id, item_id, weight AS c FROM cp UNION ALL SELECT user_id, floor({uniform(3, 'user_id', 'item_id')} * (SELECT n FROM ni))::BIGINT, NULL FROM cp),
t AS (SELECT user_id, c, [u.f[1], u.f[2], 1.0::DOUBLE, u.f[4]] AS x, [i.f[1], i.f[2], i.f[3], 1.0::DOUBLE] AS y FROM s JOIN u ON user_id = u.id JOIN i ON item_id = i.id),
r AS (SELECT *, 1 / (1 + exp(-list_dot_product(x, y))) AS p FROM t),
v AS (SELECT *, CASE WHEN c IS NULL THEN -p ELSE c * (1 - p) END AS w FROM r),
g AS (SELECT user_id, any_value(x) AS x, {sums} FROM v GROUP BY 1)
SELECT user_id, {cells}, 1.0::DOUBLE AS one FROM g"""


ORACLES: dict[str, str] = {
    "bpr_step_users_k2": _bpr_users(),
    "bpr_step_items_k2": _bpr_items(),
    "lmf_step_k2": _lmf_step(),
    "interactions_cp": f"WITH {CP} SELECT * FROM cp",
    "interactions_ev": f"WITH {EV} SELECT * FROM ev",
    "csr_rows": f"WITH {EV} SELECT user_id, string_agg(item_id::VARCHAR, ',' ORDER BY item_id) AS items, count(*)::BIGINT AS n FROM ev GROUP BY 1",
    "transposed_item_sizes": f"WITH {CP} SELECT item_id AS user_id, count(*)::BIGINT AS n, sum(weight) AS total FROM cp GROUP BY 1",
    "item_popularity": f"WITH {CP} SELECT item_id, count(*)::BIGINT AS n_users FROM cp GROUP BY 1",
    "empty_users": f"WITH {CP} SELECT id AS user_id FROM (SELECT unnest(range(0, (SELECT n FROM nu)::BIGINT)) AS id) WHERE id NOT IN (SELECT user_id FROM cp)",
    "tfidf_weight": f"""WITH {CP} SELECT user_id, item_id, round(sqrt(weight) * (ln((SELECT n FROM nu)) - ln(1 + c)), {DIGITS}) AS weight
FROM cp JOIN (SELECT item_id, count(*)::DOUBLE AS c FROM cp GROUP BY 1) USING (item_id)""",
    "bm25_weight": f"WITH {CP}, {bm25('user_id', 'item_id', 'nu', 100.0, 0.8)} SELECT user_id, item_id, round(weight, {DIGITS}) AS weight FROM w",
    "l2_normalize": f"WITH {CP} SELECT user_id, item_id, round(weight / nullif(n, 0), {DIGITS}) AS weight FROM cp JOIN (SELECT user_id, sqrt(sum(weight * weight)) AS n FROM cp GROUP BY 1) USING (user_id)",
    "alpha_scale": f"WITH {CP} SELECT user_id, item_id, weight * {ALPHA}::DOUBLE AS weight FROM cp",
    "binarize_threshold": f"WITH {CP} SELECT user_id, item_id, 1.0::DOUBLE AS weight FROM cp WHERE weight >= 25",
    "knn_all_pairs": f"WITH {EV} SELECT a.item_id AS item, b.item_id AS neighbour, round(sum(a.weight * b.weight), {DIGITS}) AS score FROM ev a JOIN ev b USING (user_id) GROUP BY 1, 2",
    "knn_raw": f"WITH {CP}, {sim('cp')} {SIM}",
    "knn_cosine": f"WITH {CP}, {COSINE_W}, {sim('w')} {SIM}",
    "knn_tfidf": f"WITH {CP}, {TFIDF_ITEM.format(x='cp')}, {sim('w')} {SIM}",
    "knn_bm25": f"WITH {BM25_SIM} {SIM}",
    "knn_recommend": f"WITH {BM25_SIM}, {recommend('cp')} SELECT * FROM recs",
    "knn_recommend_keep_liked": f"WITH {BM25_SIM}, {recommend('cp', liked=False)} SELECT * FROM recs",
    "knn_recommend_deny": f"WITH {BM25_SIM}, {recommend('cp', where=f'AND item_id NOT IN {listed(DENIED)}')} SELECT * FROM recs",
    "knn_recommend_allow": f"WITH {BM25_SIM}, {recommend('cp', where=f'AND item_id IN {listed(ALLOWED)}')} SELECT * FROM recs",
    "knn_similar_items": f"WITH {CP}, {COSINE_W}, {sim('w')} SELECT item AS query_id, rank, neighbour AS id, score FROM {top('sim', 'item', 'neighbour', N)}",
    "train_split": f"WITH {CP} SELECT * FROM cp WHERE {uniform(5, 'user_id', 'item_id')} < 0.8::DOUBLE",
    "test_split": f"WITH {CP} SELECT * FROM cp WHERE {uniform(5, 'user_id', 'item_id')} >= 0.8::DOUBLE AND weight > 0",
    "leave_k_out_train": f"WITH {SPLIT7} SELECT user_id, item_id, weight FROM marked WHERE NOT (n > 4 AND k <= 3)",
    "leave_k_out_test": f"WITH {SPLIT7} SELECT user_id, item_id, weight FROM marked WHERE n > 4 AND k <= 3",
    "train_only_users": f"WITH {CP}, {CHOSEN7} SELECT user_id FROM chosen",
    "leave_k_out_train_only": f"WITH {SPLIT7}, {CHOSEN7} SELECT user_id, item_id, weight FROM marked WHERE n > 3 AND k <= 2 AND user_id NOT IN (SELECT user_id FROM chosen)",
    "precision_at_k": f"WITH {METRICS} SELECT round(sum(hits) / sum(most), {DIGITS}) AS precision FROM m",
    "map_at_k": f"WITH {METRICS} SELECT round(avg(ap / most), {DIGITS}) AS map FROM m",
    "ndcg_at_k": f"WITH {METRICS} SELECT round(avg(dcg / (SELECT sum(1 / log2(x + 1)) FROM (SELECT unnest(range(1, {N + 1})) AS x) WHERE x <= most)), {DIGITS}) AS ndcg FROM m",
    "auc_at_k": f"WITH {METRICS} SELECT round(avg((passed + ({N} - ranks) * hits + (hits + liked) / 2 * (neg - ({N} - hits))) / nullif(liked * neg, 0)), {DIGITS}) AS auc FROM m",
    "factor_norms": f"WITH {EMB} SELECT id, round(CASE WHEN list_dot_product(f, f) = 0 THEN 1e-10 ELSE sqrt(list_dot_product(f, f)) END, {DIGITS}) AS norm FROM e",
    "nan_check": f"WITH {EMB} SELECT max(len(list_filter(f, lambda v: isnan(v))) > 0) AS has_nan FROM e",
    "gramian": f"WITH {items(FACTORS)} SELECT a.i::BIGINT AS i, b.j::BIGINT AS j, round(sum(f[a.i + 1] * f[b.j + 1]), {DIGITS}) AS value FROM i, (SELECT unnest(range(0, {FACTORS})) AS i) a, (SELECT unnest(range(0, {FACTORS})) AS j) b GROUP BY 1, 2",
    "mf_recommend": mf(UNLIKED),
    "mf_recommend_all": mf(),
    "mf_recommend_allow": mf(f"{UNLIKED} AND id IN {listed(range(1, 150, 3))}"),
    "mf_recommend_deny": mf(f"{UNLIKED} AND id NOT IN {listed(DENIED)}"),
    "mf_rank_items": mf("id IN (1, 2, 3, 4, 5, 6)", n=6),
    "mf_similar_items": f"WITH {EMB}, {scored('e', 'e', True)} SELECT query_id, rank, id, score FROM {top('scored', 'query_id', 'id', N)}",
    "mf_similar_items_deny": f"WITH {EMB}, {scored('e', 'e', True)}, open AS (SELECT * FROM scored WHERE id NOT IN {listed(DENIED)}) SELECT query_id, rank, id, score FROM {top('open', 'query_id', 'id', N)}",
    "mf_similar_users": f"WITH {users(FACTORS)}, {scored('u', 'u', True)} SELECT query_id, rank, id, score FROM {top('scored', 'query_id', 'id', N)}",
    "topk_inner_product": f"WITH {EMB}, {scored('e', 'e')} SELECT query_id, rank, id, score FROM {top('scored', 'query_id', 'id', 16)}",
    "topk_half_precision": f"WITH {EMB}, {scored('e', 'e')} SELECT query_id, rank, id, score FROM {top('scored', 'query_id', 'id', 16)}",
    "mips_augment": f"""WITH {items(FACTORS)}, n AS (SELECT id, list_dot_product(f, f) AS s, max(list_dot_product(f, f)) OVER () AS m FROM i)
SELECT id, round(sqrt(greatest(0, m - s)), {DIGITS}) AS extra, round(sqrt(m), {DIGITS}) AS norm FROM n""",
    "ivf_assign": f"WITH {EMB}, {CENTROIDS} SELECT id, cell::BIGINT AS cell FROM near WHERE p = 1",
    "ivf_search": f"""WITH {EMB}, {CENTROIDS}, scored AS (SELECT q.id AS query_id, i.id, round(list_dot_product(q.f, i.f), {DIGITS}) AS score
  FROM near q JOIN near i ON q.cell = i.cell WHERE q.p <= 8 AND i.p = 1)
SELECT query_id, rank, id, score FROM {top('scored', 'query_id', 'id', N)}""",
    "als_normal_equations_k2": f"WITH {ALS} SELECT user_id, round(a, {DIGITS}) AS a, round(b, {DIGITS}) AS b, round(d, {DIGITS}) AS d, round(p, {DIGITS}) AS p, round(q, {DIGITS}) AS q FROM eq",
    "als_half_step_k2": HALF_STEP,
    "als_half_step_cg_k2": HALF_STEP,
    "als_loss_k2": f"""WITH {CP}, {users(2)}, {items(2)},
x AS (SELECT sum(f[1] * f[1]) AS a, sum(f[1] * f[2]) AS b, sum(f[2] * f[2]) AS d FROM u),
y AS (SELECT sum(f[1] * f[1]) AS a, sum(f[1] * f[2]) AS b, sum(f[2] * f[2]) AS d FROM i),
s AS (SELECT weight AS c, u.f[1] * i.f[1] + u.f[2] * i.f[2] AS s FROM cp JOIN u ON user_id = u.id JOIN i ON item_id = i.id),
t AS (SELECT sum((abs(c) - 1) * s * s - 2 * greatest(c, 0) * s) AS e, sum(abs(c)) AS w, count(*) AS n FROM s)
SELECT round((x.a * y.a + 2 * x.b * y.b + x.d * y.d + e + w + {REG}::DOUBLE * (x.a + x.d + y.a + y.d)) / (w + (SELECT n FROM nu) * (SELECT n FROM ni) - t.n), {DIGITS}) AS loss FROM x, y, t""",
    "als_explain_k2": f"""WITH {ALS}, one AS (SELECT f[1] AS z1, f[2] AS z2 FROM i WHERE id = 1),
v AS (SELECT user_id, (d * z1 - b * z2) / (a * d - b * b) AS v1, (a * z2 - b * z1) / (a * d - b * b) AS v2 FROM eq, one),
c AS (SELECT user_id, item_id AS other_item, (y1 * v1 + y2 * v2) * c AS x FROM s JOIN v USING (user_id) WHERE c > 0),
r AS (SELECT *, sum(x) OVER (PARTITION BY user_id) AS t, row_number() OVER (PARTITION BY user_id ORDER BY x DESC, other_item DESC) AS rank FROM c)
SELECT user_id, 1::BIGINT AS item_id, other_item, round(x, {DIGITS}) AS contribution, round(t, {DIGITS}) AS total FROM r WHERE rank <= {N}""",
    "als_explain_entries_k2": f"""WITH {ALS},
v AS (SELECT user_id, item_id, (d * y1 - b * y2) / (a * d - b * b) AS v1, (a * y2 - b * y1) / (a * d - b * b) AS v2 FROM s JOIN eq USING (user_id)),
c AS (SELECT v.user_id, v.item_id, s.item_id AS other_item, (y1 * v1 + y2 * v2) * c AS x FROM v JOIN s ON v.user_id = s.user_id WHERE c > 0),
r AS (SELECT *, sum(x) OVER (PARTITION BY user_id, item_id) AS t, row_number() OVER (PARTITION BY user_id, item_id ORDER BY x DESC, other_item DESC) AS rank FROM c)
SELECT user_id, item_id, rank, other_item, round(x, {DIGITS}) AS contribution, round(t, {DIGITS}) AS total FROM r WHERE rank <= 3""",
    "als_fit_shuffle": HALF_STEP.replace(f", {DIGITS})", ", 4)"),
    "bpr_negative_verify": f"""WITH {EV}, s AS (SELECT user_id, item_id, floor({uniform(3, 'user_id', 'item_id')} * 100)::BIGINT AS other FROM ev)
SELECT * FROM s WHERE NOT EXISTS (SELECT 1 FROM ev WHERE ev.user_id = s.user_id AND ev.item_id = s.other)""",
    "bpr_scores": f"""WITH {CP}, {users(FACTORS)}, {items(FACTORS)},
s AS (SELECT user_id, item_id, floor({uniform(3, 'user_id', 'item_id')} * (SELECT n FROM ni))::BIGINT AS other FROM cp)
SELECT user_id, item_id, other, round(1 / (1 + exp(list_dot_product(u.f, a.f) - list_dot_product(u.f, b.f))), {DIGITS}) AS z
FROM s JOIN u ON user_id = u.id JOIN i a ON item_id = a.id JOIN i b ON other = b.id""",
    "lmf_positive_gradient": f"""WITH {CP}, {users(2)}, {items(2)},
s AS (SELECT user_id, i.f AS y, weight * (1 - 1 / (1 + exp(-list_dot_product(u.f, i.f)))) AS w FROM cp JOIN u ON user_id = u.id JOIN i ON item_id = i.id)
SELECT user_id, round(sum(w * y[1]), {DIGITS}) AS g1, round(sum(w * y[2]), {DIGITS}) AS g2 FROM s GROUP BY 1""",
    "dictionary_encode": "SELECT p_name, (row_number() OVER (ORDER BY p_name) - 1)::BIGINT AS code FROM (SELECT DISTINCT p_name FROM part WHERE p_name IS NOT NULL)",
    "label_join": f"""WITH {BM25_SIM}, {recommend('cp')} SELECT user_id, rank, item_id, score, p_name AS label FROM recs LEFT JOIN part ON item_id = p_partkey WHERE rank <= 3""",
    "factor_upsert": f"""WITH {items(2)}, m AS (SELECT max(id) AS m FROM i WHERE id % 3 = 0),
n AS (SELECT id, (f[1]::FLOAT + 1::FLOAT)::FLOAT AS f1, (f[2]::FLOAT + 1::FLOAT)::FLOAT AS f2 FROM i WHERE id % 3 = 0
  UNION ALL SELECT m + 10, 0.5::FLOAT, 0.25::FLOAT FROM m),
a AS (SELECT * FROM n UNION ALL SELECT id, f[1]::FLOAT, f[2]::FLOAT FROM i WHERE id NOT IN (SELECT id FROM n))
SELECT k.id, round(coalesce(f1, 0)::DOUBLE, 5) AS f1, round(coalesce(f2, 0)::DOUBLE, 5) AS f2
FROM (SELECT unnest(range(0, (SELECT max(id) + 1 FROM a))) AS id) k LEFT JOIN a USING (id)""",
    "model_round_trip": f"WITH {CP}, {COSINE_W}, {sim('w')} {SIM}",
    "fold_in_users": f"WITH {ALS} SELECT user_id, round((d * p - b * q) / (a * d - b * b), 3) + 0.0::DOUBLE AS x1, round((a * q - b * p) / (a * d - b * b), 3) + 0.0::DOUBLE AS x2 FROM eq",
}
