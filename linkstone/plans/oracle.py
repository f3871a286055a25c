"""DuckDB SQL of the same results, built from named parts that follow one another."""

from __future__ import annotations

from linkstone.functions import dictionaries as D
from linkstone.functions.text import words_sql
from linkstone.operators.blocking import CHANNEL, GROUP
from linkstone.operators.features import VECTORS
from linkstone.plans.records import NATIVE_SQL, NOISY_SQL, RECORDS_SQL


def _case(column: str, table: dict[str, str]) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table.items()) + f" ELSE {column} END"


_DIGITS = "length(regexp_replace(t, '[^0-9]', '', 'g'))"
_SPLIT = lambda s: f"list_filter(string_split_regex(regexp_replace({s}, '[^a-z0-9_\\s]', ' ', 'g'), '\\s+'), lambda t: t <> '')"
_STATES = {k: v for k, v in {**D.STATES_IN, **D.STATES_US}.items() if " " not in k}

NAMES = f"""
n1 AS (SELECT *, regexp_matches(lower(business_name), '{D.SECOND_NAME}')::TINYINT AS has_dba,
         {_SPLIT("replace(replace(replace(replace(lower(business_name), '&', ' and '), '+', ' and '), 'm/s', ' '), '@', ' at ')")} AS tk FROM records
), n2 AS (SELECT * EXCLUDE (tk), list_transform(tk, lambda t: CASE WHEN NOT regexp_full_match(t, '[0-9]+') AND NOT regexp_full_match(t, '[a-z]+') AND {_DIGITS} <= 2 AND length(t) - {_DIGITS} >= 3
           THEN translate(t, '{"".join(D.LEET)}', '{"".join(D.LEET.values())}') ELSE t END) AS tk FROM n1
), n3 AS (SELECT * EXCLUDE (tk), list_transform(tk, lambda t: {_case('t', D.LEGAL_FORMS)}) AS tk FROM n2
), n4 AS (SELECT * EXCLUDE (tk), tk[coalesce(nullif(list_position(list_transform(tk, lambda t: t IN ({words_sql(D.HONORIFIC)})), false), 0), len(tk)):] AS tk FROM n3
), n5 AS (SELECT *, list_filter(tk, lambda t: t NOT IN ({words_sql(D.LEGAL)}) AND t NOT IN ({words_sql(D.NAME_STOP)}) AND NOT (regexp_full_match(t, '[0-9]+') AND length(t) >= 4)) AS c0,
         list_filter(tk, lambda t: t NOT IN ({words_sql(D.NAME_STOP)})) AS c1 FROM n4
), named AS (SELECT entity_id, src, country, business_address, owner, has_dba, array_to_string(tk, ' ') AS nm, CASE WHEN len(c0) > 0 THEN c0 WHEN len(c1) > 0 THEN c1 ELSE tk END AS core FROM n5)"""

ADDRESSES = f"""
a1 AS (SELECT *, list_transform({_SPLIT("replace(regexp_replace(replace(lower(business_address), '#', ' '), '\\b(\\d{3})\\s(\\d{3})\\b', '\\1\\2', 'g'), '-', ' ')").replace("d3", "d{3}")}, lambda t: regexp_replace(t, '^(\\d+)(?:st|nd|rd|th|er|e|eme)$', '\\1')) AS tk FROM named
), a2 AS (SELECT * EXCLUDE (tk), list_transform(tk, lambda t: {_case('t', D.ADDRESS_WORDS)}) AS tk FROM a1
), a3 AS (SELECT * EXCLUDE (tk), list_transform(tk, lambda t: {_case('t', _STATES)}) AS tk FROM a2
), rec AS (SELECT entity_id, src, country, owner, has_dba, nm, core, array_to_string(tk, ' ') AS ad,
         list_transform(list_filter(tk, lambda t: regexp_matches(t, '[0-9]')), lambda t: coalesce(nullif(ltrim(regexp_replace(t, '[^0-9]', '', 'g'), '0'), ''), '0')) AS nums,
         list_filter(tk, lambda t: NOT regexp_full_match(t, '[0-9]+') AND (regexp_matches(t, '[0-9]') OR t NOT IN ({words_sql(D.ADDRESS_ARTICLES)}))) AS alph FROM a3)""".replace("{3}", "{3}")

KEYS = f"""
k1 AS (SELECT *, list_filter(alph, lambda t: length(t) >= 3 AND t NOT IN ({words_sql(D.ADDRESS_STOP)}) AND NOT regexp_full_match(t, '[0-9]+'))[1:8] AS al,
         list_sort(list_distinct(list_transform(list_filter(list_filter(core, lambda t, i: list_position(core, t) = i)[1:6], lambda t: length(t) >= 2), lambda t: t[1:4]))) AS pre,
         list_transform(list_filter(core, lambda t: length(t) >= 2), lambda t: t[1:4]) AS p0, array_to_string(core, '') AS cc FROM rec
), k2 AS (SELECT *, list_transform(al, lambda t: t[1:4]) AS a4, list_filter(p0, lambda t, i: list_position(p0, t) = i)[1:3] AS cp FROM k1
), k3 AS (SELECT country, entity_id AS id, src, list_distinct(flatten([
    CASE WHEN len(core) > 0 THEN ['c:' || cc, 's:' || array_to_string(list_sort(list_distinct(core)), ' ')] ELSE [] END,
    list_transform(pre, lambda p: 'u:' || p),
    flatten(list_transform(pre, lambda p, i: list_transform(pre[i + 1:], lambda q: 'p:' || p || '|' || q))),
    flatten(list_transform(nums[1:2], lambda n: list_transform(pre[1:4], lambda t: 'x:' || t || '|' || n))),
    flatten(list_transform(list_filter(nums[1:3], lambda n: length(n) <= 7), lambda n: list_transform(a4, lambda t: 'a:' || n || '|' || t))),
    CASE WHEN len(core) > 0 THEN list_transform(a4, lambda t: 'n:' || cc || '|' || t) ELSE [] END,
    flatten(list_transform(cp, lambda t: list_transform(a4[1:6], lambda u: 'm:' || t || '|' || u))),
    flatten(list_transform(list_filter(nums[1:4], lambda n: length(n) IN (5, 6)), lambda n: list_transform(core[1:3], lambda t: 'z:' || n || '|' || t[1:4])))
  ])) AS ks FROM k2
), keys AS (SELECT country, id, src, unnest(ks) AS key FROM k3)"""

_kinds = lambda table, v: ", ".join(f"'{k}'" for k, x in table.items() if x == v)
_SUMS = f"""round(sum(idf), 6) AS sc, round(sum(CASE WHEN key[1] IN ({_kinds(CHANNEL, 0)}) THEN idf ELSE 0.0 END), 6) AS sn,
  round(sum(CASE WHEN key[1] IN ({_kinds(CHANNEL, 1)}) THEN idf ELSE 0.0 END), 6) AS sa, count(*)::INTEGER AS nkeys"""
_DETAIL = "round(max(idf), 6) AS maxidf, " + ", ".join(f"sum((key[1] IN ({_kinds(GROUP, g)}))::INTEGER)::INTEGER AS g{g}" for g in range(6))
_RANKS = """(row_number() OVER (PARTITION BY s1 ORDER BY sc DESC, cand) - 1)::INTEGER AS brank, (row_number() OVER (PARTITION BY s1 ORDER BY sn DESC, cand) - 1)::INTEGER AS rank_n,
  (row_number() OVER (PARTITION BY s1 ORDER BY sa DESC, cand) - 1)::INTEGER AS rank_a"""

PAIRS = f"""
wt AS (SELECT country, key, df, ln(1 + n_c / df) AS idf FROM (SELECT country, key, count(*) AS df FROM keys WHERE src > 1 GROUP BY ALL) JOIN (SELECT country, count(*) AS n_c FROM rec WHERE src > 1 GROUP BY ALL) USING (country)
), scored AS (SELECT q.country, q.id AS s1, c.id AS cand, {_SUMS}, {_DETAIL}
  FROM keys q JOIN wt USING (country, key) JOIN keys c USING (country, key) WHERE q.src = 1 AND c.src > 1 AND df <= 300 GROUP BY ALL
), ranked AS (SELECT country, s1, cand, sc, sn, sa, nkeys, {_RANKS} FROM scored
), pairs AS (SELECT * FROM ranked WHERE brank < 12 OR (rank_n < 3 AND sn > 0) OR (rank_a < 3 AND sa > 0)
), gold AS (SELECT owner AS s1, entity_id AS cand FROM rec WHERE owner IS NOT NULL
), queries AS (SELECT country, entity_id AS s1 FROM rec WHERE src = 1
), p AS (SELECT country, s1, cand, sc, round(sc / (sc + 40), 6) AS p FROM pairs
), att AS (SELECT p.country, p.s1, p.cand, a.nm AS nm1, b.nm AS nm2, a.core AS core1, b.core AS core2, a.ad AS ad1, b.ad AS ad2, a.nums AS nums1, b.nums AS nums2, a.alph AS alph1, b.alph AS alph2,
    CASE WHEN g.cand IS NULL THEN 0 ELSE 1 END AS label
  FROM pairs p JOIN rec a ON a.entity_id = p.s1 JOIN rec b ON b.entity_id = p.cand LEFT JOIN gold g ON g.s1 = p.s1 AND g.cand = p.cand)"""

_EXPANSION = f"""
pool0 AS (SELECT scored.* FROM scored JOIN (SELECT s1, cand, {_RANKS} FROM scored) USING (s1, cand) WHERE brank < 30 OR (rank_n < 3 AND sn > 0) OR (rank_a < 3 AND sa > 0)
), seeds AS (SELECT country, s1, cand AS seed FROM (SELECT *, row_number() OVER (PARTITION BY s1 ORDER BY sc DESC, cand) AS r FROM pool0) WHERE r <= 3
), near AS (SELECT * FROM (SELECT q.country, q.id AS seed, c.id AS cand, round(sum(idf), 6) AS s, row_number() OVER (PARTITION BY q.id ORDER BY round(sum(idf), 6) DESC, c.id) AS r
  FROM keys q JOIN wt USING (country, key) JOIN keys c USING (country, key) WHERE q.src > 1 AND c.src > 1 AND df <= 300 AND q.id IN (SELECT seed FROM seeds) GROUP BY q.country, q.id, c.id) WHERE r <= 10 AND seed <> cand
), found AS (SELECT country, s1, cand, max(s) AS esc, count(*)::INTEGER AS en FROM seeds JOIN near USING (country, seed) GROUP BY ALL
), pool AS (
  SELECT country, s1, cand, sc, sn, sa, nkeys, coalesce(esc, 0) AS esc, coalesce(en, 0) AS en, 0 AS from_exp FROM pool0 LEFT JOIN found USING (country, s1, cand)
  UNION ALL SELECT country, s1, cand, 0, 0, 0, 0, esc, en, 1 FROM (SELECT *, row_number() OVER (PARTITION BY s1 ORDER BY esc DESC, cand) AS r FROM found ANTI JOIN pool0 USING (country, s1, cand)) WHERE r <= 5
), ctx AS (SELECT *, {_RANKS}, (row_number() OVER (PARTITION BY s1 ORDER BY esc DESC, cand) - 1)::INTEGER AS erank, count(*) OVER (PARTITION BY s1)::INTEGER AS n_pool,
    round(sc / greatest(max(sc) OVER (PARTITION BY s1), 1e-6), 6) AS b_rel, round(max(sc) OVER (PARTITION BY s1) - sc, 6) AS b_gap FROM pool
), comp0 AS (SELECT s1, cand, sc, count(*) OVER (PARTITION BY cand)::INTEGER AS c_nq, (row_number() OVER (PARTITION BY cand ORDER BY sc DESC, s1) - 1)::INTEGER AS c_rank, max(sc) OVER (PARTITION BY cand) AS m1 FROM pool
), comp AS (SELECT *, max(CASE WHEN c_rank = 1 THEN sc END) OVER (PARTITION BY cand) AS m2 FROM comp0)"""

_ORDER = ["records", "named", "rec", "keys", "pairs", "pool"]
_PARTS = {"records": RECORDS_SQL, "named": NAMES, "rec": ADDRESSES, "keys": KEYS, "pairs": PAIRS, "pool": _EXPANSION}


def sql(upto: str, select: str) -> str:
    """The parts up to ``upto``, further parts at the head of ``select`` after a comma, and the query."""
    parts = ",".join(_PARTS[name] for name in _ORDER[: _ORDER.index(upto) + 1])
    return f"WITH {parts}{select}"


_inter = lambda a, b: f"len(list_intersect(list_distinct({a}), list_distinct({b})))"
_dist = lambda a: f"len(list_distinct({a}))"
_union = lambda a, b: f"len(list_distinct(list_concat({a}, {b})))"
_jac = lambda a, b: f"{_inter(a, b)}::DOUBLE / {_union(a, b)}"
_full = lambda a, b: f"len({a}) > 0 AND len({b}) > 0"
_flag = lambda c: f"CASE WHEN {c} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END"
_except = lambda a, b: f"list_filter(list_distinct({a}), lambda t: NOT list_contains({b}, t))"
_lev = lambda a, b: f"round(CASE WHEN greatest(length({a}), length({b})) = 0 THEN 1.0 ELSE 1.0 - levenshtein({a}, {b})::DOUBLE / greatest(length({a}), length({b})) END, 6)"
_fhalf = "CASE WHEN predicted = 0 AND gold = 0 THEN 1.0 WHEN tp = 0 THEN 0.0 ELSE 1.25 * tp / (0.25 * gold + predicted) END"
_zips = lambda a: f"list_filter({a}, lambda x: length(x) IN (5, 6))"
_legal = lambda a: f"list_filter(string_split({a}, ' '), lambda t: t IN ({words_sql(D.LEGAL)}))"
_close = lambda t, o: f"CASE WHEN list_contains({o}, {t}) THEN 1.0 WHEN len(list_filter({o}, lambda o: length({t}) >= 4 AND length(o) >= 4 AND (left({t}, 3) = left(o, 3) OR right({t}, 3) = right(o, 3)) AND abs(length({t}) - length(o)) <= 2)) > 0 THEN 0.7 ELSE 0.0 END"
_cover = lambda a, b: f"list_sum(list_transform({a}, lambda t: ({_close('t', b)})::DOUBLE)) / len({a})"
_off = lambda a, b: f"list_sum(list_transform(range(1, length({a}) + 1), lambda i: ({a}[i] <> {b}[i])::INTEGER))"
_numsim = lambda a, b: f"(CASE WHEN {a} = {b} THEN 1.0 WHEN length({a}) = length({b}) THEN CASE WHEN {_off(a, b)} = 1 THEN 0.8 WHEN {_off(a, b)} = 2 AND length({a}) >= 4 THEN 0.4 ELSE 0.0 END WHEN least(length({a}), length({b})) >= 2 AND (starts_with({a}, {b}) OR starts_with({b}, {a}) OR ends_with({a}, {b}) OR ends_with({b}, {a})) THEN CASE WHEN abs(length({a}) - length({b})) = 1 THEN 0.7 ELSE 0.5 END ELSE 0.0 END)::DOUBLE"
_ADDED = ", over_ AS (SELECT * FROM att WHERE least(len(list_distinct(core1)), len(list_distinct(core2))) > 0 AND len(list_intersect(list_distinct(core1), list_distinct(core2))) >= 0.99 * least(len(list_distinct(core1)), len(list_distinct(core2))))"


def _grams(column: str, kind: str) -> str:
    words = f"list_filter(string_split({column}, ' '), lambda t: t <> '')"
    if kind == "w":
        return words
    n = int(kind[1:])
    return f"flatten(list_transform({words}, lambda t: CASE WHEN length(t) + 2 <= {n} THEN [' ' || t || ' '] ELSE list_transform(range(1, length(t) + 4 - {n}), lambda i: (' ' || t || ' ')[i:i + {n - 1}]) END))"


def _tfidf(column: str, kind: str, name: str) -> str:
    return sql("pairs", f""", tf AS (SELECT country, id, term, least(count(*), 2) AS tf FROM (SELECT country, entity_id AS id, unnest({_grams(column, kind)}) AS term FROM rec) GROUP BY ALL
), idf AS (SELECT country, term, ln((1.0 + n) / (1.0 + df)) + 1.0 AS idf FROM (SELECT country, term, count(*) AS df FROM tf GROUP BY ALL) JOIN (SELECT country, count(*) AS n FROM rec GROUP BY ALL) USING (country)
), w AS (SELECT country, id, term, tf * idf AS w FROM tf JOIN idf USING (country, term)), v AS (SELECT country, id, term, w / sqrt(sum(w * w) OVER (PARTITION BY country, id)) AS w FROM w)
SELECT p.s1, p.cand, round(coalesce(sum(a.w * b.w), 0), 6) AS {name} FROM pairs p LEFT JOIN v a ON a.id = p.s1 AND a.country = p.country LEFT JOIN v b ON b.id = p.cand AND b.country = p.country AND b.term = a.term GROUP BY p.s1, p.cand""")


def _budget(budget: float) -> str:
    return f""", r0 AS (SELECT s1, cand, sc, row_number() OVER (PARTITION BY s1 ORDER BY sc DESC, cand) AS r FROM pairs), r AS (SELECT * FROM r0 WHERE r <= {int(2 * budget + 5)}
), want AS (SELECT greatest(1, floor({budget} * count(DISTINCT s1))::BIGINT - sum((r <= 1)::INTEGER)) AS n FROM r
), cut AS (SELECT min(sc) AS cut FROM (SELECT sc, row_number() OVER (ORDER BY sc DESC) AS k FROM r WHERE r > 1) WHERE k <= (SELECT n FROM want))
SELECT s1, cand, sc, (r - 1)::INTEGER AS rrank FROM r WHERE r <= 1 OR sc >= (SELECT cut FROM cut)"""


_ASSIGNED = ", best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cand ORDER BY p DESC, s1) AS r FROM p) WHERE r = 1)"
_GRID = ", ".join(f"{0.2 + 0.025 * k:.3f}" for k in range(31))

def _side(p: str, a: str, b: str) -> str:
    """Statistics of the tokens that only core ``a`` has."""
    return f"""SELECT a.s1, a.cand, coalesce(max(rate), CASE WHEN count(token) = 0 THEN 0.0 ELSE -1.0 END) AS {p}_sib_max, round(coalesce(avg(rate), CASE WHEN count(token) = 0 THEN 0.0 ELSE -1.0 END), 6) AS {p}_sib_mean, count(CASE WHEN rate >= 0.85 THEN 1 END)::INTEGER AS {p}_n_sib,
  count(CASE WHEN rate <= 0.4 THEN 1 END)::INTEGER AS {p}_n_noise, count(CASE WHEN token IS NOT NULL AND rate IS NULL THEN 1 END)::INTEGER AS {p}_n_unk, coalesce(min(agree), -1.0) AS {p}_agree_min, count(CASE WHEN agree < 0.3 THEN 1 END)::INTEGER AS {p}_n_lowagree
FROM att a LEFT JOIN (SELECT country, s1, cand, token, rate, agree FROM (SELECT country, s1, cand, unnest({_except(a, b)}) AS token FROM att) LEFT JOIN ex USING (token) LEFT JOIN ag USING (country, token)) y ON y.s1 = a.s1 AND y.cand = a.cand GROUP BY a.s1, a.cand"""


_SIBLINGS = sql("pairs", _ADDED + f""", ex AS (SELECT token, round((sum(1 - label) + 0.5 * 20) / (count(*) + 20), 6) AS rate FROM (SELECT label, unnest(list_concat({_except('core1', 'core2')}, {_except('core2', 'core1')})) AS token FROM over_) GROUP BY token HAVING count(*) >= 5
), ag AS (SELECT country, token, round(avg(eq), 6) AS agree FROM (SELECT country, (nums1[1] = nums2[1])::INTEGER AS eq, unnest(list_concat({_except('core1', 'core2')}, {_except('core2', 'core1')})) AS token FROM over_ WHERE len(nums1) > 0 AND len(nums2) > 0) GROUP BY ALL HAVING count(*) >= 5
), two AS ({_side('x2', 'core2', 'core1')}), one AS ({_side('x1', 'core1', 'core2')})
SELECT * EXCLUDE (x1_sib_mean, x1_n_unk) FROM two JOIN one USING (s1, cand)""")

# phonetic keys: h and w pass, letters become digits (vowels _), runs of one digit count once, the first letter stays
_MAPPED = "translate(left({t}, 1) || regexp_replace(substr({t}, 2), '[hw]', '', 'g'), 'bfpvcgjkqsxzdtlmnraeiouyhw', '111122222222334556________')"
_RUNS = _MAPPED
for _digit in "0123456789":
    _RUNS = f"regexp_replace({_RUNS}, '{_digit}+', '{_digit}', 'g')"
_SOUND = f"CASE WHEN regexp_matches(t, '^[0-9]') THEN t ELSE left(left(t, 1) || replace(substr({_RUNS.replace('{t}', 't')}, 2), '_', '') || '000', 4) END"
_sounds = lambda c: f"list_distinct(list_transform({c}, lambda t: {_SOUND}))"
_TYPES = words_sql(D.STREET_TYPES)
_place = lambda a: f"coalesce(list_position(list_transform({a}[2:8], lambda t: t IN ({_TYPES})), true), 0)"
_street = lambda a: f"array_to_string(CASE WHEN {_place(a)} > 0 THEN {a}[greatest({_place(a)} - 2, 1) : greatest({_place(a)} - 2, 1) + least({_place(a)} + 1, 4) - 1] ELSE {a}[1:2] END, ' ')"


def _relative(column: str) -> str:
    return f"round({column} - max({column}) OVER (PARTITION BY s1), 6) AS {column}_rel1, round({column} - max({column}) OVER (PARTITION BY cand), 6) AS {column}_relc, rank() OVER (PARTITION BY s1 ORDER BY {column} DESC)::INTEGER AS {column}_rk1"


ORACLE_SQL = {
    "er_records": sql("records", " SELECT * FROM records"),
    "er_normalise_name": sql("named", " SELECT entity_id, nm, array_to_string(core, ' ') AS core, has_dba FROM named"),
    "er_normalise_address": sql("rec", " SELECT entity_id, ad, array_to_string(nums, ' ') AS nums, array_to_string(alph, ' ') AS alph FROM rec"),
    "er_key_catalogue": sql("keys", " SELECT country, id, src, key FROM keys"),
    "er_key_df_idf": sql("pairs", " SELECT country, key, df, round(idf, 6) AS idf FROM wt"),
    "er_block_topk": sql("pairs", " SELECT country, s1, cand, sc, sn, sa, nkeys, brank FROM ranked WHERE brank < 12"),
    "er_block_side_slots": sql("pairs", " SELECT country, s1, cand, sc, sn, sa, nkeys, brank, rank_n, rank_a FROM pairs"),
    "er_noaddr_cap": sql("pairs", f""", flag AS (SELECT country, id, max((key[1] IN ('n', 'm', 'a'))::INTEGER) = 0 AS no_address FROM keys WHERE src = 1 GROUP BY ALL
), s2 AS (SELECT q.country, q.id AS s1, c.id AS cand, {_SUMS} FROM keys q JOIN flag f ON f.id = q.id AND f.country = q.country JOIN wt ON wt.country = q.country AND wt.key = q.key JOIN keys c ON c.country = q.country AND c.key = q.key
  WHERE q.src = 1 AND c.src > 1 AND df <= CASE WHEN no_address THEN 40 ELSE 20 END GROUP BY ALL
), r2 AS (SELECT *, {_RANKS} FROM s2) SELECT country, s1, cand, sc, brank FROM r2 WHERE brank < 12 OR (rank_n < 3 AND sn > 0) OR (rank_a < 3 AND sa > 0)""".replace("sum(idf)", "sum(wt.idf)").replace("key[1]", "q.key[1]").replace("max((q.key[1]", "max((key[1]").replace("THEN idf", "THEN wt.idf")),
    "er_query_expansion": sql("pool", " SELECT country, s1, cand, sc, esc, en, from_exp FROM pool"),
    "er_s1_context": sql("pool", " SELECT s1, cand, brank, rank_n, rank_a, erank, n_pool, b_rel, b_gap FROM ctx"),
    "er_cand_competition": sql("pool", " SELECT s1, cand, c_nq, c_rank, round(CASE WHEN c_nq = 1 THEN 0.0 WHEN sc = m1 THEN sc - coalesce(m2, sc) ELSE sc - m1 END, 6) AS c_gap FROM comp"),
    "er_ranker_features": sql("pairs", """, rt AS (SELECT country, entity_id AS id, array_to_string(core, ' ') AS core, nums[1] AS fnum, list_filter(nums, lambda x: length(x) IN (5, 6))[1] AS zip, (ad = '')::INTEGER AS ad_empty, len(core)::INTEGER AS ntok,
  (count(*) OVER (PARTITION BY country, src = 1, array_to_string(core, ' ')))::INTEGER AS core_freq FROM rec
), rf AS (SELECT p.s1, p.cand, a.ad_empty AS ad_empty1, b.ad_empty AS ad_empty2, a.ntok AS ntok1, b.ntok AS ntok2, a.core_freq AS core_freq1, b.core_freq AS core_freq2, (a.core = b.core)::INTEGER AS core_eq, coalesce((a.fnum = b.fnum)::INTEGER, -1) AS fnum_eq, coalesce((a.zip = b.zip)::INTEGER, -1) AS zip_eq,
    (p.cand LIKE 'S3-%')::INTEGER AS src3, round(jaro_winkler_similarity(a.core, b.core), 6) AS jw_core, round(p.sc / max(p.sc) OVER (PARTITION BY p.s1), 6) AS b_rel FROM pairs p JOIN rt a ON a.id = p.s1 JOIN rt b ON b.id = p.cand)
SELECT * EXCLUDE (b_rel), (row_number() OVER (PARTITION BY s1 ORDER BY round(jw_core + 0.001 * b_rel, 9) DESC, cand) - 1)::INTEGER AS jw_rank, round(jw_core - max(jw_core) OVER (PARTITION BY s1), 6) AS jw_rel FROM rf"""),
    "er_closure": sql("pairs", " SELECT s1, cand FROM pairs WHERE cand IN (SELECT cand FROM pairs WHERE right(s1, 1) = '5')"),
    "er_pair_context": sql("pairs", """, c0 AS (SELECT s1, cand, sc, count(*) OVER (PARTITION BY cand)::INTEGER AS cand_ns1, rank() OVER (PARTITION BY cand ORDER BY sc DESC)::INTEGER AS cand_rank, row_number() OVER (PARTITION BY cand ORDER BY sc DESC, s1) AS o,
  max(sc) OVER (PARTITION BY cand) AS m1, count(*) OVER (PARTITION BY s1)::INTEGER AS n_cand_s1, round(CASE WHEN max(sc) OVER (PARTITION BY s1) > 0 THEN sc / max(sc) OVER (PARTITION BY s1) ELSE 0.0 END, 6) AS b_rel FROM pairs
), c1 AS (SELECT *, max(CASE WHEN o = 2 THEN sc END) OVER (PARTITION BY cand) AS m2 FROM c0)
SELECT s1, cand, b_rel, n_cand_s1, cand_ns1, cand_rank, round(CASE WHEN cand_ns1 = 1 THEN 0.0 WHEN sc = m1 THEN sc - coalesce(m2, sc) ELSE sc - m1 END, 6) AS cand_gap FROM c1"""),
    "er_budget_select": sql("pairs", _budget(8.0)),
    "er_set_features": sql("pairs", f""" SELECT s1, cand, round({_jac('core1', 'core2')}, 6) AS core_jac, round({_inter('core1', 'core2')}::DOUBLE / greatest(1, least({_dist('core1')}, {_dist('core2')})), 6) AS core_ovl_min,
  {_flag("array_to_string(core1, '') <> '' AND array_to_string(core1, '') = array_to_string(core2, '')")} AS concat_eq,
  {_flag("array_to_string(core1, '') <> '' AND array_to_string(core2, '') <> '' AND (contains(array_to_string(core1, ''), array_to_string(core2, '')) OR contains(array_to_string(core2, ''), array_to_string(core1, '')))")} AS concat_sub,
  {_flag("core1[1] = core2[1]")} AS first_tok_eq, {_inter(_legal('nm1'), _legal('nm2'))}::DOUBLE AS legal_common,
  {_flag(f"{_full(_legal('nm1'), _legal('nm2'))} AND {_inter(_legal('nm1'), _legal('nm2'))} = 0")} AS legal_conflict, len(core1)::DOUBLE AS n_core1, len(core2)::DOUBLE AS n_core2,
  {_flag("array_to_string(core1, '') <> '' AND array_to_string(core2, '') <> '' AND (contains(replace(nm2, ' ', ''), array_to_string(core1, '')) OR contains(replace(nm1, ' ', ''), array_to_string(core2, '')))")} AS name_in_other,
  round({_inter('core1', 'core2')}::DOUBLE / {_dist('core1')}, 6) AS core_cov1, round({_inter('core1', 'core2')}::DOUBLE / {_dist('core2')}, 6) AS core_cov2,
  len(list_filter(string_split(nm2, ' '), lambda t: regexp_full_match(t, '[0-9]+') AND NOT list_contains(string_split(nm1, ' '), t)))::DOUBLE AS nm_digit_tok2 FROM att"""),
    "er_number_features": sql("pairs", f""" SELECT s1, cand, {_inter('nums1', 'nums2')}::DOUBLE AS num_common, round(CASE WHEN {_full('nums1', 'nums2')} THEN {_jac('nums1', 'nums2')} ELSE -1.0 END, 6) AS num_jac,
  CASE WHEN {_full('nums1', 'nums2')} THEN {_flag('nums1[1] = nums2[1]')} ELSE -1.0::DOUBLE END AS first_num_eq, {_flag(f"{_full('nums1', 'nums2')} AND NOT list_contains(nums2, nums1[1])")} AS num_conflict_first,
  CASE WHEN {_full(_zips('nums1'), _zips('nums2'))} THEN {_flag(f"{_inter(_zips('nums1'), _zips('nums2'))} > 0")} ELSE -1.0::DOUBLE END AS zip_eq,
  {_flag(f"{_full(_zips('nums1'), _zips('nums2'))} AND {_inter(_zips('nums1'), _zips('nums2'))} = 0")} AS zip_conflict, len(nums1)::DOUBLE AS n_nums1, len(nums2)::DOUBLE AS n_nums2,
  round(CASE WHEN {_full('alph1', 'alph2')} THEN {_jac('alph1', 'alph2')} ELSE -1.0 END, 6) AS alph_jac, ({_dist('alph1')} + {_dist('nums1')})::DOUBLE AS addr_len1, ({_dist('alph2')} + {_dist('nums2')})::DOUBLE AS addr_len2,
  round(CASE WHEN len(alph2) > 0 THEN {_inter('alph1', 'alph2')}::DOUBLE / {_dist('alph2')} ELSE -1.0 END, 6) AS ad_cov2, round(CASE WHEN len(nums2) > 0 THEN {_inter('nums1', 'nums2')}::DOUBLE / {_dist('nums2')} ELSE -1.0 END, 6) AS num_cov2 FROM att"""),
    "er_fuzzy_cover": sql("pairs", f""" SELECT s1, cand, round({_cover('list_distinct(core1)', 'core2')}, 6) AS tok_fuzzy_cov1, round({_cover('list_distinct(core2)', 'core1')}, 6) AS tok_fuzzy_cov2,
  round(CASE WHEN {_full('alph1', 'alph2')} AND len(list_filter(alph1, lambda t: length(t) >= 3)) > 0 THEN {_cover('list_distinct(list_filter(alph1, lambda t: length(t) >= 3))', 'alph2')} ELSE -1.0 END, 6) AS alph_fuzzy_cov1,
  CASE WHEN {_full('nums1', 'nums2')} THEN {_numsim('nums1[1]', 'nums2[1]')} ELSE -1.0::DOUBLE END AS first_num_sim,
  CASE WHEN {_full('nums1', 'nums2')} THEN list_max(flatten(list_transform(nums1[1:4], lambda a: list_transform(nums2[1:4], lambda b: {_numsim('a', 'b')})))) ELSE -1.0::DOUBLE END AS best_num_sim,
  CASE WHEN {_full('alph1', 'alph2')} THEN {_flag('list_has_any(alph1[-2:], alph2[-2:])')} ELSE -1.0::DOUBLE END AS last_alph_eq FROM att"""),
    "er_idf_mass": sql("pairs", f""", tdf AS (SELECT field, token, count(*) AS df FROM (SELECT 'core' AS field, unnest(list_distinct(core)) AS token FROM rec UNION ALL SELECT 'alph', unnest(list_distinct(alph)) FROM rec) GROUP BY ALL
), n AS (SELECT count(*)::DOUBLE AS n FROM rec), x AS (
  SELECT s1, cand, 'nm_sh' AS part, 'core' AS field, unnest(list_intersect(list_distinct(core1), list_distinct(core2))) AS token FROM att UNION ALL SELECT s1, cand, 'nm_un1', 'core', unnest({_except('core1', 'core2')}) FROM att
  UNION ALL SELECT s1, cand, 'nm_un2', 'core', unnest({_except('core2', 'core1')}) FROM att UNION ALL SELECT s1, cand, 'ad_sh', 'alph', unnest(list_intersect(list_distinct(alph1), list_distinct(alph2))) FROM att
  UNION ALL SELECT s1, cand, 'ad_un1', 'alph', unnest({_except('alph1', 'alph2')}) FROM att UNION ALL SELECT s1, cand, 'ad_un2', 'alph', unnest({_except('alph2', 'alph1')}) FROM att
), y AS (SELECT s1, cand, part, ln((n + 1) / (df + 1)) AS v FROM x JOIN tdf USING (field, token), n)
SELECT a.s1, a.cand, """ + ", ".join(f"round(coalesce(sum(CASE WHEN part = '{p}' THEN v END), 0), 6) AS {p}_idf" for p in ("nm_sh", "nm_un1", "nm_un2", "ad_sh", "ad_un1", "ad_un2")) + ", round(coalesce(max(CASE WHEN part = 'nm_sh' THEN v END), 0), 6) AS nm_sh_idf_max FROM att a LEFT JOIN y ON y.s1 = a.s1 AND y.cand = a.cand GROUP BY a.s1, a.cand"),
    "er_edit_features": sql("pairs", f""" SELECT s1, cand, {_lev('nm1', 'nm2')} AS lev_nm, CASE WHEN ad1 <> '' AND ad2 <> '' THEN {_lev('ad1', 'ad2')} ELSE -1.0::DOUBLE END AS lev_ad,
  round(jaro_winkler_similarity(array_to_string(core1, ''), array_to_string(core2, '')), 6) AS jw_core, round(jaro_winkler_similarity(core1[1], core2[1]), 6) AS jw_first FROM att"""),
    "er_tfidf_cosine_word": _tfidf("array_to_string(core, ' ')", "w", "cos_w_core"),
    "er_tfidf_cosine_char3": _tfidf("nm", "c3", "cos_c3_nm"),
    "er_token_df": sql("rec", " SELECT field, token, count(*) AS df FROM (SELECT 'core' AS field, unnest(list_distinct(core)) AS token FROM rec UNION ALL SELECT 'alph', unnest(list_distinct(alph)) FROM rec) GROUP BY ALL"),
    "er_rarity": sql("pairs", """, kk AS (SELECT country, src, entity_id AS id, array_to_string(core, '') AS name_key, CASE WHEN len(nums) > 0 AND len(list_filter(alph, lambda t: length(t) >= 3)) > 0 THEN nums[1] || '|' || array_to_string(list_filter(alph, lambda t: length(t) >= 3)[1:2], ' ') ELSE '' END AS addr_key FROM rec
), nc AS (SELECT country, name_key, sum((src = 1)::INTEGER)::BIGINT AS n_s1, sum((src > 1)::INTEGER)::BIGINT AS n_c FROM kk GROUP BY ALL), ac AS (SELECT country, addr_key, sum((src > 1)::INTEGER)::BIGINT AS a_c FROM kk WHERE addr_key <> '' GROUP BY ALL)
SELECT p.s1, p.cand, n1.n_s1 AS nmfreq_s1_in_s1, n1.n_c AS nmfreq_s1_in_c, n2.n_c AS nmfreq_c_in_c, n2.n_s1 AS nmfreq_c_in_s1, coalesce(a1.a_c, -1)::BIGINT AS adfreq_s1_in_c, coalesce(a2.a_c, -1)::BIGINT AS adfreq_c_in_c,
  CASE WHEN x.addr_key <> '' AND y.addr_key <> '' THEN (x.addr_key = y.addr_key)::INTEGER ELSE -1 END AS adkey_eq
FROM pairs p JOIN kk x ON x.id = p.s1 JOIN kk y ON y.id = p.cand JOIN nc n1 ON n1.country = x.country AND n1.name_key = x.name_key JOIN nc n2 ON n2.country = y.country AND n2.name_key = y.name_key
LEFT JOIN ac a1 ON a1.country = x.country AND a1.addr_key = x.addr_key LEFT JOIN ac a2 ON a2.country = y.country AND a2.addr_key = y.addr_key"""),
    "er_extra_token_table": sql("pairs", _ADDED + f", t AS (SELECT label, unnest(list_concat({_except('core1', 'core2')}, {_except('core2', 'core1')})) AS token FROM over_) SELECT token, count(*) AS n, round((sum(1 - label) + 0.5 * 20) / (count(*) + 20), 6) AS rate FROM t GROUP BY token HAVING count(*) >= 5"),
    "er_agree_table": sql("pairs", _ADDED + f", t AS (SELECT country, (nums1[1] = nums2[1])::INTEGER AS eq, unnest(list_concat({_except('core1', 'core2')}, {_except('core2', 'core1')})) AS token FROM over_ WHERE len(nums1) > 0 AND len(nums2) > 0) SELECT country, token, count(*) AS n, round(avg(eq), 6) AS agree FROM t GROUP BY ALL HAVING count(*) >= 5"),
    "er_sibling_stats": _SIBLINGS,
    "er_candidate_cut": sql("pairs", " SELECT s1, cand, sc, (row_number() OVER (PARTITION BY s1 ORDER BY sc DESC, cand) - 1)::INTEGER AS brank FROM ranked WHERE brank < 6 OR (rank_n < 2 AND sn > 0) OR (rank_a < 2 AND sa > 0)"),
    "er_assign_one_to_one": sql("pairs", " SELECT s1, cand, p FROM (SELECT *, row_number() OVER (PARTITION BY cand ORDER BY p DESC, s1) AS r FROM p WHERE p >= 0.65) WHERE r = 1"),
    "er_threshold_grid": sql("pairs", _ASSIGNED + f""", g AS (SELECT unnest([{_GRID}])::DOUBLE AS threshold), per AS (SELECT best.s1, threshold, count(gold.cand) AS tp, count(*) AS predicted FROM best JOIN g ON threshold <= p LEFT JOIN gold ON gold.s1 = best.s1 AND gold.cand = best.cand GROUP BY ALL
), gn AS (SELECT s1, count(*) AS gold FROM gold GROUP BY ALL), rows_ AS (SELECT q.s1, g.threshold, coalesce(tp, 0) AS tp, coalesce(predicted, 0) AS predicted, coalesce(gold, 0) AS gold FROM queries q CROSS JOIN g LEFT JOIN per ON per.s1 = q.s1 AND per.threshold = g.threshold LEFT JOIN gn ON gn.s1 = q.s1)
SELECT threshold, round(avg({_fhalf}), 6) AS f FROM rows_ GROUP BY threshold"""),
    "er_blend_nan_mean": sql("pairs", ", m AS (SELECT s1, cand, p, CASE WHEN nkeys % 3 = 0 THEN NULL ELSE round(sn / (sn + 10), 6) END AS ce1, CASE WHEN nkeys % 2 = 0 THEN NULL ELSE round(sa / (sa + 10), 6) END AS ce2 FROM p JOIN pairs USING (s1, cand)) SELECT s1, cand, round(coalesce((coalesce(ce1, 0) + coalesce(ce2, 0)) / nullif((ce1 IS NOT NULL)::INTEGER + (ce2 IS NOT NULL)::INTEGER, 0), p), 8) AS ce, round(0.5 * p + 0.5 * coalesce((coalesce(ce1, 0) + coalesce(ce2, 0)) / nullif((ce1 IS NOT NULL)::INTEGER + (ce2 IS NOT NULL)::INTEGER, 0), p), 8) AS blend FROM m"),
    "er_expected_f_decision": sql("pairs", """, e AS (SELECT s1, cand, p, row_number() OVER w AS k, sum(p) OVER (PARTITION BY s1 ORDER BY p DESC, cand ROWS UNBOUNDED PRECEDING) AS sum_k, sum(p) OVER (PARTITION BY s1) AS total, exp(sum(ln(greatest(1 - p, 1e-12))) OVER (PARTITION BY s1)) AS none_ FROM p WINDOW w AS (PARTITION BY s1 ORDER BY p DESC, cand)
), e2 AS (SELECT *, round(1.25 * sum_k / (0.25 * total + k), 9) AS gain FROM e), e3 AS (SELECT *, max(gain) OVER (PARTITION BY s1) AS best FROM e2), e4 AS (SELECT *, min(CASE WHEN gain = best THEN k END) OVER (PARTITION BY s1) AS cut FROM e3)
SELECT s1, cand, p, k::INTEGER AS k FROM e4 WHERE k <= cut AND best > round(none_, 9)"""),
    "er_macro_f05": sql("pairs", _ASSIGNED + f""", pr AS (SELECT s1, cand FROM (SELECT *, row_number() OVER (PARTITION BY cand ORDER BY p DESC, s1) AS r2 FROM p WHERE p >= 0.65) WHERE r2 = 1), x AS (SELECT q.country, q.s1, (SELECT count(*) FROM pr WHERE pr.s1 = q.s1) AS predicted, (SELECT count(*) FROM gold g WHERE g.s1 = q.s1) AS gold, (SELECT count(*) FROM pr JOIN gold g ON g.s1 = pr.s1 AND g.cand = pr.cand WHERE pr.s1 = q.s1) AS tp FROM queries q)
SELECT country, count(*) AS n, round(avg({_fhalf}), 6) AS f FROM x GROUP BY country"""),
    "er_recall_ceiling": sql("pairs", """, x AS (SELECT q.country, q.s1, (SELECT count(*) FROM gold g WHERE g.s1 = q.s1) AS gold, (SELECT count(*) FROM gold g JOIN pairs p ON p.s1 = g.s1 AND p.cand = g.cand WHERE g.s1 = q.s1) AS found, (SELECT count(*) FROM pairs p WHERE p.s1 = q.s1) AS cands FROM queries q)
SELECT country, sum(gold)::BIGINT AS n_gold, sum(found)::BIGINT AS found, round(sum(found)::DOUBLE / sum(gold), 6) AS recall, round(avg(cands), 6) AS per_query, round(avg(CASE WHEN gold = 0 THEN 1.0 WHEN found = 0 THEN 0.0 ELSE 1.25 * (found::DOUBLE / gold) / (0.25 + found::DOUBLE / gold) END), 6) AS ceiling FROM x GROUP BY country"""),
    "er_k_sweep": sql("pairs", ", k AS (SELECT unnest([1, 2, 3, 5, 8, 12, 20, 45]) AS k) SELECT k::INTEGER AS k, count(gold.cand) AS found, round(count(gold.cand)::DOUBLE / (SELECT count(*) FROM gold), 6) AS recall, round(count(*)::DOUBLE / (SELECT count(*) FROM queries), 6) AS per_query FROM ranked JOIN k ON brank < k LEFT JOIN gold ON gold.s1 = ranked.s1 AND gold.cand = ranked.cand GROUP BY k"),
    "er_miss_taxonomy": sql("pairs", """, lost AS (SELECT g.s1, g.cand, r.brank, a.country AS q_country, c.country AS c_country FROM gold g JOIN rec a ON a.entity_id = g.s1 JOIN rec c ON c.entity_id = g.cand LEFT JOIN ranked r ON r.s1 = g.s1 AND r.cand = g.cand WHERE r.brank IS NULL OR r.brank >= 2
), sh AS (SELECT l.s1, l.cand, min(df) AS min_df FROM lost l JOIN keys q ON q.id = l.s1 JOIN keys c ON c.id = l.cand AND c.key = q.key AND c.country = q.country JOIN wt ON wt.key = q.key AND wt.country = q.country GROUP BY ALL)
SELECT q_country AS country, CASE WHEN c_country <> q_country THEN 'not_in_country' WHEN brank < 45 THEN 'rank_13_45' WHEN brank < 60 THEN 'rank_46_60' WHEN min_df IS NULL THEN 'no_shared_key' WHEN min_df > 300 THEN 'only_df_gt_cap' ELSE 'rank_gt_60' END AS category, count(*) AS n FROM lost LEFT JOIN sh USING (s1, cand) GROUP BY ALL"""),
    "er_expansion_sweep": sql("pool", ", o AS (SELECT s1, cand, CASE WHEN from_exp = 1 THEN row_number() OVER (PARTITION BY s1, from_exp ORDER BY esc DESC, cand) ELSE 0 END AS pl FROM pool), k AS (SELECT unnest([0, 1, 2, 3, 5]) AS added) SELECT added::INTEGER AS added, count(gold.cand) AS found FROM o JOIN k ON pl <= added LEFT JOIN gold ON gold.s1 = o.s1 AND gold.cand = o.cand GROUP BY added"),
    "er_new_pairs_anti": sql("pairs", " SELECT s1, cand FROM pairs WHERE NOT (brank < 4)"),
    "er_uncertain_cascade": sql("pairs", " SELECT s1, cand, p, round(least(p, 1 - p), 6) AS uncertainty FROM p WHERE round(least(p, 1 - p), 6) > 0.2 ORDER BY uncertainty DESC, s1, cand LIMIT 500"),
    "er_uncertain_pairs": sql("pairs", " SELECT s1, cand, p, round(least(p, 1 - p), 6) AS uncertainty FROM p WHERE round(least(p, 1 - p), 6) > 0.002"),
    "er_unseen_rescale": sql("pairs", " SELECT s1, cand, round(CASE WHEN country IN ('en', 'de', 'es') THEN p ELSE least(p * 0.65 / 0.7875, 0.999) END, 6) AS p FROM p"),
    "er_output_lists": sql("pairs", ", pr AS (SELECT s1, cand FROM (SELECT *, row_number() OVER (PARTITION BY cand ORDER BY p DESC, s1) AS r FROM p WHERE p >= 0.65) WHERE r = 1) SELECT q.s1, coalesce((SELECT string_agg(cand, ',' ORDER BY cand) FROM pr WHERE pr.s1 = q.s1), '') AS ids FROM queries q"),
    "er_validate_output": sql("pairs", """, l AS (SELECT s1, list_sort(list(cand)) AS ids FROM pairs WHERE brank < 3 AND right(s1, 1) <> '7' GROUP BY s1 UNION ALL SELECT s1, [s1, 'X9', min(cand), min(cand)] FROM pairs WHERE right(s1, 1) = '3' GROUP BY s1
), f AS (SELECT 'duplicate_row' AS "check", s1 AS subject FROM l GROUP BY s1 HAVING count(*) > 1 UNION ALL SELECT 'duplicate_id', s1 FROM l WHERE len(ids) <> len(list_distinct(ids)) UNION ALL SELECT 'self_match', id FROM (SELECT unnest(ids) AS id FROM l) WHERE id LIKE 'S1-%'
  UNION ALL SELECT 'wrong_prefix', id FROM (SELECT unnest(ids) AS id FROM l) WHERE NOT regexp_matches(id, '^S[123]-') UNION ALL SELECT 'missing_row', s1 FROM queries WHERE s1 NOT IN (SELECT s1 FROM l))
SELECT "check", count(*) AS n, array_to_string(list_sort(list(DISTINCT subject))[1:5], ',') AS examples FROM f GROUP BY "check\""""),
    "er_link": sql("pairs", " SELECT country, s1, cand, p FROM (SELECT *, row_number() OVER (PARTITION BY cand ORDER BY p DESC, s1) AS r FROM p WHERE p >= 0.65) WHERE r = 1"),
    "er_normalise_noisy": f"WITH {RECORDS_SQL}, {NOISY_SQL}, {NAMES.replace('FROM records', 'FROM noisy').replace('owner, has_dba', 'owner, is_dom, has_dba')}, {ADDRESSES.replace('owner, has_dba', 'owner, is_dom, has_dba')} SELECT entity_id, nm, array_to_string(core, ' ') AS core, is_dom, has_dba, ad, array_to_string(nums, ' ') AS nums, array_to_string(alph, ' ') AS alph FROM rec",
    "er_token_map": f"WITH {RECORDS_SQL}, {NATIVE_SQL} SELECT native, latin FROM (SELECT *, row_number() OVER (PARTITION BY native ORDER BY score DESC, met DESC, latin DESC) AS k FROM judged) WHERE k = 1",
    "er_block_detail": sql("pairs", " SELECT s1, cand, maxidf, g0, g1, g2, g3, g4, g5 FROM scored JOIN ranked USING (s1, cand) WHERE brank < 12"),
    "er_street": sql("pairs", f""" SELECT s1, cand, CASE WHEN {_street('alph1')} <> '' AND {_street('alph2')} <> '' THEN {_lev(_street('alph1'), _street('alph2'))} ELSE -1.0::DOUBLE END AS lev_street, {_flag("ad2 = ''")} AS ad_empty2, 0.0::DOUBLE AS is_dom_2, 0.0::DOUBLE AS has_dba_2, substr(cand, 2, 1)::DOUBLE AS src,
  round(least(length(nm1), length(nm2))::DOUBLE / greatest(length(nm1), length(nm2), 1), 6) AS len_ratio_nm FROM att"""),
    "er_soundex_cov": sql("pairs", f""", so AS (SELECT s1, cand, {_sounds('core1')} AS x1, {_sounds('core2')} AS x2 FROM att) SELECT s1, cand, round(len(list_intersect(x1, x2))::DOUBLE / len(x1), 6) AS sdx_cov1, round(len(list_intersect(x1, x2))::DOUBLE / len(x2), 6) AS sdx_cov2 FROM so"""),
    "er_relative_context": f"SELECT s1, cand, name_x_addr, {_relative('cos_c3_nm')}, {_relative('name_x_addr')} FROM (SELECT s1, cand, cos_c3_nm, round(cos_c3_nm * CASE WHEN ad2 = '' THEN 0.5 ELSE cos_c3_ad END, 6) AS name_x_addr FROM ({_tfidf('nm', 'c3', 'cos_c3_nm')}) JOIN ({_tfidf('ad', 'c3', 'cos_c3_ad')}) USING (s1, cand) JOIN ({sql('pairs', ' SELECT s1, cand, ad2 FROM att')}) USING (s1, cand))",
    **{f"er_tfidf_{kind}_{column}": _tfidf(f"array_to_string({column}, ' ')" if column in ("core", "alph") else column, kind, f"cos_{kind}_{column}") for column, kind in VECTORS if (column, kind) not in (("core", "w"), ("nm", "c3"))},
}
_RECALL_AT = lambda b: sql("pairs", f""", keep AS ({_budget(b).lstrip(', ').replace('r0 AS', 'WITH r0 AS', 1)}), x AS (SELECT q.country, q.s1, (SELECT count(*) FROM gold g WHERE g.s1 = q.s1) AS gold, (SELECT count(*) FROM gold g JOIN keep p ON p.s1 = g.s1 AND p.cand = g.cand WHERE g.s1 = q.s1) AS found, (SELECT count(*) FROM keep p WHERE p.s1 = q.s1) AS cands FROM queries q)
SELECT {b}::DOUBLE AS budget, country, sum(gold)::BIGINT AS n_gold, sum(found)::BIGINT AS found, round(sum(found)::DOUBLE / sum(gold), 6) AS recall, round(avg(cands), 6) AS per_query, round(avg(CASE WHEN gold = 0 THEN 1.0 WHEN found = 0 THEN 0.0 ELSE 1.25 * (found::DOUBLE / gold) / (0.25 + found::DOUBLE / gold) END), 6) AS ceiling FROM x GROUP BY country""")  # noqa: E731
ORACLE_SQL["er_budget_recall"] = " UNION ALL ".join(f"SELECT * FROM ({_RECALL_AT(b)})" for b in (2.0, 5.0, 8.0))
